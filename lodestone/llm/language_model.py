"""Language-model scoring by a weighted backoff automaton of order three.

Counts are of all training documents: tokens, pairs and triples of neighbouring
tokens, a document's first token following the start mark. Smoothing is a
Dirichlet prior on the next lower order:

    P(w)       = (c(w) + 1) / (N + V + 1)
    P(w | v)   = (c(v w) + m1 P(w)) / (c(v) + m1)
    P(w | u v) = (c(u v w) + m2 P(w | v)) / (c(u v) + m2)

The model is an automaton. Its states are histories: the empty one, each token v
with c(v) > 0, and each pair u v with c(u v) > 0. A state has an arc for
every token seen after its history, weighted log10 P, that leads to the longest
history that ends the history and the token; and a failure arc to the state of
the history less its first token, weighted log10(m / (c + m)). The empty history
has an arc for every token. A text is walked from left to right from the start
mark's state: while the state has no arc for the next token its failure arc is
taken, then the token's arc; the weights add up to the text's log10 probability.

Documents are walked side by side: each step takes the states that the last one
left and moves them all by arrays. A long document is cut into stretches; as a
state depends on the last two tokens alone, a stretch that begins two tokens
early, without counting these, has the state that the walk would have carried to
it. The steps are so bounded by ``STRETCH``.

The automaton of the whole corpus is never built. Each chunk of documents asks
for the counts of its own distinct tokens and pairs, then of the triples whose
first pair is a state, and so has exactly the states and arcs that its documents
can visit; a bucket sums the training chunks' counts. So memory follows the chunk
and the bucket, and a token that stands in every document is one entry per chunk.
Each reply carries the bucket's number of types and tokens, from which a chunk
sums V and N.

Tokens, pairs and triples are known by 64-bit hashes: those that share a hash
share a count. Of a hash, the bucket's row carries 48 bits; the others are the
bucket's number and the place of the key in the sorted row.

Defined cases: a null or empty text is its end token alone; a null doc_id is a
training document without a remainder; repeated rows and ids count and are
scored each on its own; without training documents N = V = 0. Other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T

FOLDS, HELD_OUT = 7, 2
#: Weights m1 and m2 of the lower order, in tokens.
MASS = (5.0, 2.0)
#: Occurrences of a pair that is a state: every pair of the training documents is one.
LEAST = 1
#: Bytes of text in a chunk: the larger, the fewer distinct triples it sends for each byte.
CHUNK_BYTES = 12 << 20
#: Tokens of a document that are walked one after the other.
STRETCH = 1024

#: Fixed hashes of the end token and the start mark.
END = np.uint64(0x5DEECE66D1CE4E5B)
START = np.uint64(0x2545F4914F6CDD1D)
#: Bits of a hash that a key carries.
LOW_BITS = 48

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(ids: np.ndarray, known: np.ndarray, folds: int) -> np.ndarray:
    """CRC-32 of each id's decimal text modulo ``folds``; -1 without an id."""
    return np.array([zlib.crc32(str(i).encode()) % folds if k else -1 for i, k in zip(ids.tolist(), known.tolist())], np.int64)


class Tokens:
    """A chunk's tokens in order, each document closed by its end token."""

    def __init__(self, table: pa.Table, folds: int, held_out: int):
        words = T.Words(*T.flat(table.column("text")), T.SPACED)
        ids, known = C.doc_ids(table)
        self.held = remainder(ids, known, folds) == held_out
        self.counts = words.counts + 1
        self.edges = np.concatenate(([0], np.cumsum(self.counts)))
        self.token = np.insert(words.hashes(lower=True), words.first[1:], END)
        self.train = np.repeat(~self.held, self.counts)
        first = self.edges[:-1]
        self.begins = np.zeros(len(self.token), bool)
        self.begins[first] = True
        before = _shifted(self.token)
        before[first] = START
        # The history START counts once a document: it is asked for as a token of its own.
        starts = np.zeros(1, np.uint64) + START
        self.types, inverse = np.unique(np.concatenate((self.token, starts)), return_inverse=True)
        self.type_of, self.start_type = inverse[:-1], int(inverse[-1])
        self.type_count = np.bincount(self.type_of[self.train], minlength=len(self.types))
        self.type_count[self.start_type] = int((~self.held).sum())
        #: Type before each token.
        self.before = _shifted(self.type_of)
        self.before[first] = self.start_type
        pair = T.mix(before * np.uint64(0x9E3779B97F4A7C15) + self.token)
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.pair_count = np.bincount(self.pair_of[self.train], minlength=len(self.pairs))
        self.triple_hash = T.mix(_shifted(pair) * np.uint64(0xD6E8FEB86659FD93) + self.token)

    def triples(self, pair_total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose history is a pair that is a state, the distinct triples there, and each place's triple."""
        at = np.flatnonzero(~self.begins)
        at = at[pair_total[self.pair_of[at - 1]] >= LEAST]
        triples, of = np.unique(self.triple_hash[at], return_inverse=True)
        return at, triples, of


def _shifted(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def _sub_buckets(bits: int) -> int:
    return 1 << max(0, 64 - LOW_BITS - bits)


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted hashes of one bucket: how many fall into each sub-bucket, then the low bits of each.

    The first byte is the width of those numbers.
    """
    if not len(keys):
        return b""
    n = _sub_buckets(bits)
    sub = np.bincount((keys >> np.uint64(LOW_BITS)).astype(np.int64) & (n - 1), minlength=n)
    width = 1 if sub.max() < 256 else 4
    return bytes([width]) + sub.astype(f"<u{width}").tobytes() + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes()


def unpack_keys(data: bytes, bits: int, bucket: int) -> np.ndarray:
    """The whole hashes again."""
    if not data:
        return np.zeros(0, np.uint64)
    n, width = _sub_buckets(bits), data[0]
    sub = np.repeat(np.arange(n, dtype=np.uint64), np.frombuffer(data, f"<u{width}", n, 1))
    out = np.zeros((len(sub), 8), np.uint8)
    out[:, : LOW_BITS // 8] = np.frombuffer(data, np.uint8, offset=1 + width * n).reshape(len(sub), -1)
    # Where buckets have more than 16 bits, the low bits hold some of the bucket's: an or leaves them as they are.
    return out.reshape(-1).view("<u8") | sub << np.uint64(LOW_BITS) | np.uint64(bucket << (64 - bits))


def _edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted((hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))


def _ask(chunk: int, bits: int, groups: list[tuple[np.ndarray, np.ndarray]], every: bool) -> pa.Table:
    """A row for each bucket (``every`` one, or those with keys): the keys of one or two groups, and their counts.

    ``n`` is the number of keys of the first group.
    """
    edges = [_edges(keys, bits) for keys, _ in groups]
    used = np.arange(1 << bits) if every else np.flatnonzero(np.diff(edges[0]))
    keys, extra = [], []
    for b in used:
        cuts = [slice(e[b], e[b + 1]) for e in edges]
        keys.append(b"".join(pack_keys(k[x], bits) for (k, _), x in zip(groups, cuts)))
        extra.append(_numbers(np.concatenate([c[x] for (_, c), x in zip(groups, cuts)])))
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
            "n": pa.array(np.diff(edges[0])[used], pa.int32()),
            "keys": pa.array(keys, pa.binary()),
            "extra": pa.array(extra, pa.binary()),
        }
    )


def _key_bytes(data: bytes, n: int, bits: int) -> int:
    """Bytes that the first ``n`` keys take."""
    return 1 + data[0] * _sub_buckets(bits) + n * LOW_BITS // 8 if n else 0


def _totals(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sum of the counts of each entry's key, part by part; the distinct keys and their sums."""
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    return np.split(sums[inverse], np.cumsum([len(x) for x in parts])[:-1]), keys, sums


def _numbers(x: np.ndarray) -> bytes:
    """Numbers, compressed, in the narrowest width that holds them."""
    most = int(x.max(initial=0))
    return C.squeeze(x.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if not most >> (8 * w))))


def _read(n: int, body: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(body, decompressed_size=zstandard.frame_content_size(body), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _count(bits: int):
    """Total counts for each chunk's tokens and pairs, after the bucket's types and tokens."""

    def count(bucket: int, rows: list[dict]):
        types, pairs, type_n, pair_n = [], [], [], []
        for r in rows:
            n, cut = r["n"], _key_bytes(r["keys"], r["n"], bits)
            types.append(unpack_keys(r["keys"][:cut], bits, bucket))
            pairs.append(unpack_keys(r["keys"][cut:], bits, bucket))
            counts = _read(n + len(pairs[-1]), r["extra"])
            type_n.append(counts[:n])
            pair_n.append(counts[n:])
        t_parts, keys, sums = _totals(types, type_n)
        sums = sums[keys != START]
        p_parts, _, _ = _totals(pairs, pair_n)
        head = np.array([int((sums > 0).sum()), int(sums.sum())], "<i8").tobytes()
        for r, t, p in zip(rows, t_parts, p_parts):
            yield r["chunk"], len(t) + len(p), head + _numbers(np.concatenate((t, p)))

    return count


def _count_triples(bits: int):
    def count(bucket: int, rows: list[dict]):
        parts, _, _ = _totals([unpack_keys(r["keys"], bits, bucket) for r in rows], [_read(r["n"], r["extra"]) for r in rows])
        for r, x in zip(rows, parts):
            yield r["chunk"], len(x), _numbers(x)

    return count


class Counts:
    """The corpus counts of a chunk's tokens and pairs."""

    def __init__(self, tokens: Tokens, replies: dict[int, tuple[int, bytes]], bits: int):
        te, pe = _edges(tokens.types, bits), _edges(tokens.pairs, bits)
        self.type = np.zeros(len(tokens.types), np.int64)
        self.pair = np.zeros(len(tokens.pairs), np.int64)
        self.types = self.total = 0
        for b, (n, data) in replies.items():
            v, total = np.frombuffer(data, "<i8", 2).tolist()
            self.types += v
            self.total += total
            counts = _read(n, data[16:])
            k = te[b + 1] - te[b]
            self.type[te[b] : te[b + 1]] = counts[:k]
            self.pair[pe[b] : pe[b + 1]] = counts[k:]


class Automaton:
    """The states and arcs that a chunk's documents can visit.

    State 0 is the empty history, then come the types, then the pairs of the
    chunk; those that are no state are not reached. The arcs of types and pairs
    are sorted by state and token; the empty history's arcs stand by token.
    """

    def __init__(self, tokens: Tokens, counts: Counts, triples: tuple[np.ndarray, np.ndarray, np.ndarray], triple_total: np.ndarray, mass: tuple[float, float]):
        n_types, n_pairs = len(tokens.types), len(tokens.pairs)
        self.n_types = n_types
        self.start = 1 + tokens.start_type
        prob = (counts.type + 1) / (counts.total + counts.types + 1)
        # The state after a token or a pair: the longest history that there is.
        after_type = np.where(counts.type > 0, 1 + np.arange(n_types), 0)
        first = np.zeros(n_pairs, np.int64)
        first[tokens.pair_of] = np.arange(len(tokens.token))
        left, right = tokens.before[first], tokens.type_of[first]
        after_pair = np.where(counts.pair >= LEAST, 1 + n_types + np.arange(n_pairs), after_type[right])
        self.root_weight, self.root_to = np.log10(prob), after_type
        self.failure_weight = np.concatenate(([0.0], np.log10(mass[0] / (counts.type + mass[0])), np.log10(mass[1] / (counts.pair + mass[1]))))
        self.failure_to = np.concatenate(([0], np.zeros(n_types, np.int64), after_type[right]))
        pair_prob = (counts.pair + mass[0] * prob[right]) / (counts.type[left] + mass[0])
        at, _, of = triples
        place = np.zeros(len(triple_total), np.int64)
        place[of] = at
        low = tokens.pair_of[place]
        history = tokens.pair_of[place - 1]
        triple_prob = (triple_total + mass[1] * pair_prob[low]) / (counts.pair[history] + mass[1])
        keys = np.concatenate(((1 + left) * n_types + right, (1 + n_types + history) * n_types + tokens.type_of[place]))
        seen = np.concatenate((counts.pair, triple_total)) > 0
        order = np.flatnonzero(seen)[np.argsort(keys[seen], kind="stable")]
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate((pair_prob, triple_prob)))[order]
        self.to = np.concatenate((after_pair, after_pair[low]))[order]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the tokens, and the weights of the arcs taken."""
        weight = np.zeros(len(state))
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            now, want = state[todo], token[todo]
            root = now == 0
            out[todo[root]] = self.root_to[want[root]]
            weight[todo[root]] += self.root_weight[want[root]]
            todo, now, want = todo[~root], now[~root], want[~root]
            if not len(todo):
                break
            key = now * self.n_types + want
            place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            there = self.keys[place] == key if len(self.keys) else np.zeros(len(todo), bool)
            out[todo[there]] = self.to[place[there]]
            weight[todo[there]] += self.weight[place[there]]
            todo, now = todo[~there], now[~there]
            weight[todo] += self.failure_weight[now]
            state = state.copy()
            state[todo] = self.failure_to[now]
        return out, weight

    def walk(self, tokens: Tokens) -> np.ndarray:
        """Log10 weight of each position's move."""
        cuts = -(-tokens.counts // STRETCH)
        doc = np.repeat(np.arange(len(cuts)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = tokens.edges[doc] + nth * STRETCH
        end = np.minimum(begin + STRETCH, tokens.edges[doc + 1])
        # A later stretch warms up on the two tokens before it.
        at = np.where(nth > 0, begin - 2, begin)
        state = np.where(nth > 0, 0, self.start)
        order = np.argsort(at - end, kind="stable")
        at, end, state, begin = at[order], end[order], state[order], begin[order]
        out = np.zeros(len(tokens.token))
        while len(at):
            state, weight = self.step(state, tokens.type_of[at])
            counted = at >= begin
            out[at[counted]] = weight[counted]
            at = at + 1
            # The longest stretches stand first.
            n = int(np.count_nonzero(at < end))
            at, end, state, begin = at[:n], end[:n], state[:n], begin[:n]
        return out


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, mass: tuple[float, float] = MASS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every document with the model of the documents outside the held-out fold."""
    spark = docs.sparkSession
    parts, bits = C.partitions(spark), C.bucket_bits(spark)
    chunks = C.pack(docs, parts, chunk_bytes)

    def ask(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = Tokens(C.load(payload.as_py()), folds, held_out)
                yield from _ask(chunk, bits, [(tokens.types, tokens.type_count), (tokens.pairs, tokens.pair_count)], True).to_batches()

    def ask_triples(chunk, table, replies):
        tokens = Tokens(table, folds, held_out)
        at, triples, of = tokens.triples(Counts(tokens, replies, bits).pair)
        return _ask(chunk, bits, [(triples, np.bincount(of[tokens.train[at]], minlength=len(triples)))], False)

    def finish(chunk, table, replies):
        tokens = Tokens(table, folds, held_out)
        counts = Counts(tokens, {b: r for b, r in replies.items() if b < 1 << bits}, bits)
        triples = tokens.triples(counts.pair)
        total, edges = np.zeros(len(triples[1]), np.int64), _edges(triples[1], bits)
        for b, (n, data) in replies.items():
            if b >= 1 << bits:
                total[edges[b - (1 << bits)] : edges[b - (1 << bits) + 1]] = _read(n, data)
        model = Automaton(tokens, counts, triples, total, mass)
        add = lambda x: np.add.reduceat(x, tokens.edges[:-1])  # noqa: E731  no document is without a token
        return pa.Table.from_arrays(
            [
                table.column("doc_id").combine_chunks(),
                pa.array(tokens.held),
                pa.array(tokens.counts.astype(np.int64)),
                pa.array(add((counts.type[tokens.type_of] > 0).astype(np.int64))),
                pa.array(np.full(table.num_rows, counts.total, np.int64)),
                pa.array(add(model.root_weight[tokens.type_of])),
                pa.array(add(model.walk(tokens))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    replies = C.answer(chunks.mapInArrow(ask, C.ASK_SCHEMA), parts, _count(bits)).repartition(parts, "chunk")
    asked = C.meet(chunks, replies, parts, ask_triples, C.ASK_SCHEMA, dealt=True)
    # Replies on triples are told from the first ones by the bucket's number.
    more = C.answer(asked, parts, _count_triples(bits)).withColumn("bucket", (F.col("bucket") + F.lit(1 << bits)).cast("int"))
    both = replies.unionByName(more.repartition(parts, "chunk"))
    return C.meet(chunks, both, parts, finish, SCORED, dealt=True).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
