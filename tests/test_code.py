"""Scanner of modules against tables written by hand, in both keyword languages."""

import hashlib

from lodestone.sources import code

RUSSIAN = '''#Область Служебные
// Считает остаток.
//
// Параметры:
//  Товар - ссылка
// Возвращаемое значение:
//  Число - остаток
&НаСервере
Функция Остаток(Знач Товар, Дата = '20240101', Текст = "а,""б""", Прочее = Неопределено) Экспорт
	// Вызов() в комментарии
	Если Пусто(Товар) Тогда
		Возврат 0;
	КонецЕсли;
	Строка = "Нет() здесь
	|и Тут() тоже";
	Запрос = Новый Запрос(Текст());
	Сумма = Общий.Модуль.Свернуть(Товар, Вложить(1, 2), );
	Выполнить("Склады.Обновить(1, ""х, у"",)");
	Оповещение = Новый ОписаниеОповещения("ПослеВыбора", ЭтотОбъект);
	#Если Сервер Тогда
	Конец();
	#КонецЕсли
	Возврат Сумма;
КонецФункции

#Область Вложенная
&Вместо("ПриЗаписи")
&НаКлиенте // пояснение
Асинх Процедура Расш_ПриЗаписи(
	Отказ, // флаг
	Параметры)
	ПродолжитьВызов(Отказ);
КонецПроцедуры
#КонецОбласти
#КонецОбласти
Процедура БезКонца()
	Тест ( )
'''

ENGLISH = """// Not a comment of the routine

&AtClient
procedure Open(Val Item, Count = -1) export
	if (Count > 0) then
		Form.Items.Add(Item, Count);
	endif;
	Execute("Reset()");
	Handler = New NotificationDescription("AfterClose", Module);
	Evaluate(Expression);
	/* Gone() */
endprocedure
function Twice(x)
	return Twice(Twice(x));
endfunction
"""


def scan(text):
    return code.Scanner(text).routines()


def test_russian_routines():
    a, b, c = scan(RUSSIAN)
    assert (a.line, a.kind, a.name, a.export, a.directives, a.area) == (9, "Function", "Остаток", True, ["&НаСервере"], "Служебные")
    assert a.parameters == [("Товар", True, None), ("Дата", False, "'20240101'"), ("Текст", False, '"а,""б"""'), ("Прочее", False, "Неопределено")]
    assert (a.description, a.doc_parameters, a.doc_returns) == ("Считает остаток.", " Товар - ссылка", " Число - остаток")
    assert a.body.startswith("\t// Вызов()") and a.body.endswith("Возврат Сумма;")
    assert (b.kind, b.name, b.area, b.directives) == ("Procedure", "Расш_ПриЗаписи", "Служебные.Вложенная", ['&Вместо("ПриЗаписи")', "&НаКлиенте"])
    assert b.decorator() == ("Вместо", "ПриЗаписи") and [p[0] for p in b.parameters] == ["Отказ", "Параметры"] and b.description == ""
    assert (c.name, c.area, c.parameters, c.body) == ("БезКонца", None, [], "\tТест ( )")


def test_russian_calls():
    a, b, c = scan(RUSSIAN)
    assert a.calls == [
        (11, "direct", None, "Пусто", 1),
        (16, "direct", None, "Текст", 0),
        (17, "qualified", "Общий.Модуль", "Свернуть", 3),
        (17, "direct", None, "Вложить", 2),
        (18, "dynamic", "Склады", "Обновить", 2),
        (19, "notification", "ЭтотОбъект", "ПослеВыбора", None),
        (21, "direct", None, "Конец", 0),
    ]
    assert b.calls == [(32, "direct", None, "ПродолжитьВызов", 1)]
    assert c.calls == [(37, "direct", None, "Тест", 0)]


def test_english_module():
    a, b = scan(ENGLISH.replace("\n", "\r\n"))
    assert (a.line, a.kind, a.name, a.export, a.directives, a.description) == (4, "Procedure", "Open", True, ["&AtClient"], "")
    assert a.parameters == [("Item", True, None), ("Count", False, "-1")]
    assert a.calls == [(6, "qualified", "Form.Items", "Add", 2), (8, "dynamic", None, "Reset", 0), (9, "notification", None, "AfterClose", None), (10, "direct", None, "Evaluate", 1)]
    assert (b.name, b.calls) == ("Twice", [(14, "direct", None, "Twice", 1), (14, "direct", None, "Twice", 1)])


def test_broken_sources():
    assert scan("") == [] and scan("// nothing") == [] and scan('"open string') == []
    (x,) = scan("Процедура Обрыв(А, Б")
    assert (x.name, [p[0] for p in x.parameters], x.body) == ("Обрыв", ["А", "Б"], "")
    a, b = scan("Procedure A()\n\tx();\nProcedure B()\nEndProcedure\n#EndRegion")
    assert (a.body, [c[3] for c in a.calls], b.body) == ("\tx();", ["x"], "")
    assert scan("МояПроцедура(1)\nПроцедураДва()") == []


def test_scanner_as_spark_job(spark):
    rows = [(1, RUSSIAN, "x"), (2, ENGLISH, "y"), (3, None, "z"), (4, "", "w"), (5, ENGLISH, "y")]
    df = spark.createDataFrame(rows, "id long, source string, name string").repartition(3)
    found = code.routines(df, "id", "source").orderBy("id", "line").collect()
    assert [(r["id"], r["name"]) for r in found] == [(1, "Остаток"), (1, "Расш_ПриЗаписи"), (1, "БезКонца"), (2, "Open"), (2, "Twice"), (5, "Open"), (5, "Twice")]
    assert found[0]["parameters"][1].asDict() == {"name": "Дата", "by_value": False, "default": "'20240101'"}
    assert found[1]["decorator"] == "Вместо" and found[0]["body_sha256"] == hashlib.sha256(found[0]["body"].encode()).hexdigest()
    calls = code.calls(df, "id", "source")
    assert calls.count() == 9 + 2 * 6 and calls.where("kind = 'dynamic'").count() == 3
