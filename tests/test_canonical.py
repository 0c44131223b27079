"""Hash trees of forms: what changes a hash and what does not."""

from xml.etree import ElementTree

from lodestone.sources import canonical


def root(text):
    e = ElementTree.fromstring(text)
    return canonical.hashes(e)[e]


def test_writing_does_not_change_a_hash():
    a = root('<F id="1" b="2" a="1"><P>x</P><Q id="7"/></F>')
    assert a == root('<F a="1" id="99" b="2">\n  <P> x </P>\n  <Q/>\n</F>')
    assert a == root("<F b='2' a='1'><!-- note --><P>x</P><Q></Q></F>")


def test_content_changes_a_hash():
    texts = ['<F a="1"><P>x</P><Q/></F>', '<F a="2"><P>x</P><Q/></F>', '<F a="1"><P>y</P><Q/></F>', '<F a="1"><Q/><P>x</P></F>', '<F a="1"><P>x</P></F>', '<F a="1"><P>x</P><Q/>t</F>', '<G a="1"><P>x</P><Q/></G>', '<F a="1" b=""><P>x</P><Q/></F>', '<F xmlns="u" a="1"><P>x</P><Q/></F>']
    assert len({root(t) for t in texts}) == len(texts)


FORM = """<Form><ChildItems>
<Group name="G" id="1"><Title>Top</Title><ChildItems><Field id="2" name="A"><Path>P.A</Path></Field>{extra}</ChildItems></Group>
<Field name="B" id="3"><Path>{path}</Path></Field><Label name="{name}" id="4"/><Field name="N" id="50"/><Field name="X" id="x"/><Field name="Y"/>
</ChildItems><BaseForm><ChildItems>
<Group id="1" name="G"><Title> Top </Title><ChildItems><Field name="A" id="2"><Path>P.A</Path></Field></ChildItems></Group>
<Field id="3" name="B"><Path>old</Path></Field><Field id="3" name="B"><Path>P.B</Path><Mark/></Field><Field name="C" id="4"/></ChildItems></BaseForm></Form>"""


def test_states_and_modified_properties(spark):
    rows = [(1, FORM.format(extra="", path="P.B", name="C")), (2, FORM.format(extra='<Field id="9" name="D"/>', path="P.Z", name="CC")), (3, None), (4, "<broken"), (5, "<Form/>"), (6, FORM.format(extra="", path="P.B", name="C"))]
    df = spark.createDataFrame(rows, "form long, text string").repartition(3)
    got = {(r["form"], r["name"]): (r["state"], r["modified"]) for r in canonical.states(canonical.controls(df, "form", "text"), "form").collect()}
    assert len(got) == 7 + 8 + 7
    assert got[1, "G"] == ("adopted_unchanged", None) and got[1, "A"] == ("adopted_unchanged", None)
    assert got[1, "B"] == ("adopted_modified", ["Mark"])  # the last of two base controls counts
    assert got[1, "C"] == ("adopted_modified", ["@kind"])
    assert [got[1, n][0] for n in "NXY"] == ["own"] * 3
    assert got[2, "G"] == ("adopted_modified", ["ChildItems"]) and got[2, "A"] == ("adopted_unchanged", None)
    assert got[2, "B"] == ("adopted_modified", ["Mark", "Path"]) and got[2, "CC"] == ("adopted_modified", ["@kind", "@name"])
    assert got[2, "D"] == ("own", None)
