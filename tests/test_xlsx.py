import datetime as dt
import io
import subprocess
import sys
import zipfile
from pathlib import Path

from ledgerloom.sources import xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def book(sheets, strings=(), styles="", rels=None, props=""):
    """``sheets``: (name, relation, xml of rows); ``rels``: relation to target."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="{r}"/>' for i, (n, r, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}>{props}<sheets>{listed}</sheets></workbook>")
        rels = rels or {r: f"worksheets/sheet{i}.xml" for i, (_, r, _) in enumerate(sheets, 1)}
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {RELS}>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in rels.items()) + "</Relationships>")
        for _, r, rows in sheets:
            name = rels[r].lstrip("/")
            z.writestr(name if name.startswith("xl/") else f"xl/{name}", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


def cells(*values, row=1):
    return f'<row r="{row}">' + "".join(values) + "</row>"


def test_strings_are_what_is_written(spark, tmp_path):
    strings = ["<t>作品</t><rPh sb='0' eb='2'><t>サクヒン</t></rPh><phoneticPr fontId='1'/>", "<r><t>太</t></r><r><rPr><b/></rPr><t xml:space='preserve'>字 </t></r><rPh sb='0' eb='1'><t>フト</t></rPh>", "<t>a_x000D_b</t>", ""]
    rows = cells('<c r="A1" t="s"><v>0</v></c>', '<c r="C1" t="s"><v>1</v></c>', '<c t="s"><v>2</v></c>', '<c t="s"><v>3</v></c>', '<c r="AA1" t="inlineStr"><is><r><t>x</t></r><rPh sb="0" eb="1"><t>y</t></rPh></is></c>')
    rows += "<row><c><v>5.50</v></c><c t='str'><f>A1</f><v>q</v></c><c t='b'><v>1</v></c><c t='b'><v>0</v></c><c t='e'><v>#N/A</v></c><c/><c t='d'><v>2026-05-01</v></c></row>"
    (tmp_path / "a.xlsx").write_bytes(book([("S", "rId1", rows)], strings))
    got = sorted(xlsx.read_xlsx(spark, str(tmp_path)).collect(), key=lambda r: r.row_index)
    assert got[0].cells == ["作品", None, "太字 ", "a\rb", "", *[None] * 21, "x"]
    assert (got[1].row_index, got[1].cells) == (2, ["5.50", "q", "true", "false", None, None, "2026-05-01"])


def test_sheets_are_found_by_their_relation(spark, tmp_path):
    number = lambda n: cells(f"<c><v>{n}</v></c>")
    swapped = {"rId3": "worksheets/sheet2.xml", "rId1": "/xl/worksheets/sheet1.xml", "rId9": "worksheets/deep/../sheet10.xml"}
    data = book([("two", "rId3", number(2)), ("one", "rId1", number(1)), ("ten", "rId9", "")], rels=swapped)
    assert list(xlsx.sheets(data)) == [("two", 1, ["2"]), ("one", 1, ["1"])]
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(data)
    out = xlsx.read_xlsx(spark, str(tmp_path))
    assert sorted((r.place, r.sheet, r.cells[0]) for r in out.collect()) == [(0, "two", "2")] * 3 + [(1, "one", "1")] * 3


def test_formats_that_mean_dates():
    formats = {170: "yyyy/m/d", 171: "#,##0", 172: '[Red]0.0"day"', 173: "[h]:mm:ss", 174: "yyyy年m月d日 h:mm", 175: "General", 176: "m月", 177: "0.00_);(0.00)", 178: "[$-411]ggge年m月d日"}
    styles = "<numFmts>" + "".join(f'<numFmt numFmtId="{k}" formatCode="{v.replace(chr(34), "&quot;")}"/>' for k, v in formats.items()) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, *formats, 22, 20)) + "</cellXfs>"
    row = cells(*(f'<c s="{i}"><v>46173.5</v></c>' if i != 5 else '<c s="5"><v>0.25</v></c>' for i in range(13)))
    want = ["46173.5", *["2026-05-31 12:00:00"] * 2, "46173.5", "46173.5", "06:00:00", "2026-05-31 12:00:00", "46173.5", "2026-05-31 12:00:00", "46173.5", "2026-05-31 12:00:00", "2026-05-31 12:00:00", "2026-05-31 12:00:00"]
    assert next(iter(xlsx.sheets(book([("S", "r1", row)], styles=styles))))[2] == want
    late = book([("S", "r1", cells('<c s="1"><v>44711</v></c>', '<c s="1" t="str"><v>44711</v></c>', '<c s="99"><v>1</v></c>'))], styles=styles, props='<workbookPr date1904="1"/>')
    assert next(iter(xlsx.sheets(late)))[2] == ["2026-05-31", "44711", "1"]
    early = book([("S", "r1", cells('<c s="1"><v>1</v></c>', '<c s="1"><v>61</v></c>', '<c s="1"><v>9999999999</v></c>'))], styles=styles)
    assert next(iter(xlsx.sheets(early)))[2] == ["1900-01-01", "1900-03-01", "9999999999"]


def test_the_weekly_report(spark, tmp_path):
    text = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
    head = cells(*map(text, ("x", "Date", "Channel Title(JP)", "Channel", "Title(KR)", "Title(JP)", "Sales Amount")), row=3)
    line = lambda n, *c: cells(*c, row=n)
    rows = cells(text("Weekly"), row=1) + head + line(4, text(""), '<c s="1"><v>46173</v></c>', text("ch"), text("cmoa"), text("작품"), text("作品"), "<c><v>99.5</v></c>")
    rows += line(5, text(""), text("2026/5/3"), text(""), text("cmoa"), text(""), text("B"), text("¥1,200")) + line(6, text(""), text("2026-05-03"), text(""), text(""), text(""), text("B"), "<c><v>5</v></c>") + line(7, text(""), text("bad"), text(""), text("c"), text(""), text("B"), "<c><v>5</v></c>")
    plain = cells(text("h"), row=1) + cells(text("x"), row=2) + cells(*map(text, ("T", "K", "CT", "C", "2026-05-04")), "<c><v>7</v></c>", row=3)
    (tmp_path / "a.xlsx").write_bytes(book([("first", "r1", plain), ("Daily_Raw", "r2", rows)], styles=styles))
    (tmp_path / "b.xlsx").write_bytes(book([("p", "r1", plain)]))
    got = sorted(tuple(r) for r in xlsx.weekly_rows(xlsx.read_xlsx(spark, str(tmp_path))).collect())
    assert got == [("B", "", "", "cmoa", dt.date(2026, 5, 3), 1200), ("T", "K", "CT", "C", dt.date(2026, 5, 4), 7), ("作品", "작품", "ch", "cmoa", dt.date(2026, 5, 31), 100)]


def test_a_large_sheet_in_little_memory(tmp_path):
    path = tmp_path / "large.xlsx"
    n = 500_000
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {RELS}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>作品{i}</t></si>" for i in range(20_000)) + "</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {NS}><sheetData>".encode())
            for i in range(0, n, 10_000):
                f.write("".join(f'<row r="{k + 1}"><c r="A{k + 1}" t="s"><v>{k % 20_000}</v></c><c r="B{k + 1}"><v>{k}</v></c><c r="C{k + 1}"><v>7</v></c></row>' for k in range(i, i + 10_000)).encode())
            f.write(b"</sheetData></worksheet>")
    code = f"import resource, sys; from ledgerloom.sources import xlsx; n = sum(1 for _ in xlsx.sheets(open({str(path)!r}, 'rb').read())); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(xlsx.__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == n and int(out[1]) < 500
