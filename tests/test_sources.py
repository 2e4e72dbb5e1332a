from datetime import date

import pytest

from cohortloom import sources
from cohortloom.operators import attach_crosswalk
from cohortloom.sources.schemas import ENROLLMENTS

HEADER = [name for name, _, _ in ENROLLMENTS]


def write(path, lines, sep):
    path.write_text("\n".join(sep.join(line) for line in lines) + "\n")
    return str(path)


def test_enrollments(spark, tmp_path):
    record = dict.fromkeys(HEADER, "NA") | {
        "PIDM": "11", "TERM_CODE": "201230", "ENROLLED_AFTER_HS_GRAD": "Y",
        "LAST_NAME": "O'Example", "BIRTH_DATE": "05-JUN-1995", "FINAL_GRADE": "B+",
        "COURSE_SUBJECT": "MATH", "COURSE_NUMBER": "1050", "ADDRESS_ZIP": "84095-1234",
        "HIGH_SCHOOL": "No. #1 High", "AGE_ON_FIRST_DAY": "x",
    }
    shuffled = HEADER[::-1]
    path = write(tmp_path / "ce.tsv", [shuffled, [record[h] for h in shuffled]], "\t")
    for header in (None, shuffled):
        ce = sources.read_enrollments(spark, path, header=header)
        row = ce.first()
        assert (row.sid, row.term, row.last_name, row.birth_date) == (11, 201230, "O'Example", date(1995, 6, 5))
        assert row.high_school == "No. #1 High"
        assert row.hs_grad_year is None and row.age_first_day is None and row.gender is None
    done = sources.prepare_enrollments(ce, source="extract", drop=("crn",)).first()
    assert (done.enrolled_after_01, done.ever_nonconcurrent_01) == (1, None)
    assert (done.course_year, done.course_sem, done.grade_num) == (2012, "Summer", 3.3)
    assert (done["class"], done.zip5, done.source, done.ce_term) == ("MATH 1050", 84095.0, "extract", "Y")
    assert "crn" not in done


def test_spells_blank_colleges(spark, tmp_path):
    header = [name for name, _, _ in sources.SPELLS]
    base = {"Graduated.": "N", "Record.Found.Y.N": "Y", "Enrollment.Begin": "20120501"}
    lines = [header]
    for i, college in enumerate(["", '""', "NA", '"A, B"']):
        record = base | {"Requester.Return.Field": str(i), "College.Name": college}
        lines.append([record.get(h, "NA") for h in header])
    spells = sources.prepare_spells(
        sources.read_spells(spark, write(tmp_path / "nsc.csv", lines, ","))
    )
    got = [(r.sid, r.college, r.term) for r in spells.orderBy("sid").collect()]
    assert got == [(0, "", 201230), (1, "", 201230), (2, "", 201230), (3, "A, B", 201230)]


def test_spaced_header_is_the_same_column(spark, tmp_path):
    path = write(tmp_path / "s.csv", [["College Name"], ["X"]], ",")
    layout = (("College.Name", "college", "string"),)
    assert sources.read_spells(spark, path, layout).first().college == "X"
    with pytest.raises(ValueError, match="Missing"):
        sources.read_spells(spark, path, (("Missing", "m", "int"),))


@pytest.mark.parametrize("sep", [",", "\t"])
def test_export_round_trip(spark, tmp_path, sep):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "tab\there")], "k int, v string")
    out = str(tmp_path / "out")
    sources.write_delimited(df, out, sep)
    back = spark.read.csv(out, sep=sep, header=True, nullValue="NA", quote='"', escape='"', schema="k int, v string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        sources.write_delimited(df, out, sep)


def test_crosswalk_attaches_and_rejects_repeats(spark, rows):
    fact = spark.createDataFrame([("S1",), ("S9",), (None,)], "school string")
    good = sources.crosswalk(
        spark.createDataFrame([("S1", "D1"), ("S2", None)], "school string, district string"), "school", "district"
    )
    assert rows(attach_crosswalk(fact, good, "school")) == [("S1", "D1"), ("S9", None), (None, None)]
    bad = sources.crosswalk(
        spark.createDataFrame([("S1", "D1"), ("S1", "D2")], "school string, district string"), "school", "district"
    )
    with pytest.raises(Exception, match="crosswalk repeats"):
        attach_crosswalk(fact, bad, "school").collect()


# Rejected lines

LAYOUT = (("Id", "k", "long"), ("Day", "day", "date"), ("Note", "note", "string"), ("Age", "age", "int"))
LINES = [
    ["Id", "Day", "Note", "Age"], ["1", "05-JUN-1995", "x", "17"], ["2", "31-FEB-1995", "NA", "seventeen"],
    ["3", "05-JUN-1995", "short"], ["4", "NA", "long", "17", "more"], ["five", "", '"a, b"', " 18 "], ["6", "NA", "NA", "NA"],
]


def test_rejected_lines_are_kept(spark, tmp_path):
    path = write(tmp_path / "f.csv", LINES, ",")
    found = sources.readers.read_delimited(spark, path, LAYOUT, ",", corrupt="bad").collect()
    assert [(r.k, r.bad) for r in found] == [
        (1, None), (2, None), (3, "3,05-JUN-1995,short"), (4, "4,NA,long,17,more"), (None, None), (6, None),
    ]
    assert (found[2].note, found[2].age, found[4].note, found[4].age) == ("short", None, "a, b", 18)
    # The line is told from the number of its fields whatever columns are asked for.
    few = sources.readers.read_delimited(spark, path, LAYOUT, ",", corrupt="bad").select("k", "bad")
    assert len(few.filter("bad is not null").collect()) == 2


def test_audit_counts_what_is_rejected(spark, tmp_path):
    path = write(tmp_path / "f.csv", LINES, ",")
    for header in (None, LINES[0]):
        found = sources.audit_delimited(spark, path, LAYOUT, ",", header).collect()
        assert [tuple(r) for r in found] == [
            ("(line)", "as many fields as the header", 6, 2, "3,05-JUN-1995,short"),
            ("k", "long", 6, 1, "five"), ("day", "date", 6, 1, "31-FEB-1995"), ("age", "int", 6, 1, "seventeen"),
        ]
    text_only = sources.audit_delimited(spark, path, LAYOUT[2:3], ",").collect()
    assert [tuple(r) for r in text_only] == [("(line)", "as many fields as the header", 6, 2, "3,05-JUN-1995,short")]
    empty = write(tmp_path / "none.csv", LINES[:1], ",")
    assert {(r.n_lines, r.n_rejected, r.example) for r in sources.audit_delimited(spark, empty, LAYOUT, ",").collect()} == {(0, 0, None)}


def test_lines_are_written_as_they_are(spark, tmp_path):
    lines = ['1,"a', " b ", "", 'c""d,,', "#e"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    out = str(tmp_path / "lines")
    for _ in range(2):
        sources.write_lines(df, out, "head,er")
    text = [p.read_text().splitlines() for p in tmp_path.glob("lines/part-*")]
    assert {t[0] for t in text if t} == {"head,er"}
    assert sorted(x for t in text for x in t[1:]) == sorted(filter(None, lines))


# Exports


@pytest.fixture
def exported(spark):
    rows = [(i, f'no. "{i}", tab\there\nline' if i % 5 else None, date(2000, 2, 28), i / 8) for i in range(200)]
    return spark.createDataFrame(rows, "k long, v string, day date, x double").repartition(4)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_export_is_read_back(spark, tmp_path, exported, sep):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no complete export"):
        sources.read_export(spark, path, sep)
    manifest = sources.export_delimited(exported, path, sep).collect()
    assert sum(r.rows for r in manifest if r.part) == 200 == next(r.rows for r in manifest if not r.part)
    back = sources.read_export(spark, path, sep)
    assert back.dtypes == exported.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, exported.collect()))


def test_export_again_writes_nothing(spark, tmp_path, exported):
    path = str(tmp_path / "out")

    def files():
        return {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}

    sources.export_delimited(exported, path)
    before = files()
    sources.export_delimited(exported.repartition(2), path)  # equal rows
    assert files() == before
    other = exported.filter("k < 50")
    sources.export_delimited(other, path)
    assert sources.read_export(spark, path).count() == 50
    sources.export_delimited(other.limit(0), path)
    assert sources.read_export(spark, path).count() == 0


def test_parts_must_be_those_of_the_manifest(spark, tmp_path, exported):
    path = str(tmp_path / "out")
    sources.export_delimited(exported, path)
    part = sorted(tmp_path.glob("out/parts-*/part-*"))[0]
    part.write_text(part.read_text() + "7,late,28-Feb-2000,1.0\n")
    for check in tmp_path.glob("out/parts-*/.*.crc"):
        check.unlink()
    with pytest.raises(ValueError, match=part.name):
        sources.read_export(spark, path)


def test_broken_off_write_is_no_export(spark, tmp_path, exported, monkeypatch):
    path = str(tmp_path / "out")
    monkeypatch.setattr(sources.writers, "_read_parts", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sources.export_delimited(exported, path)
    with pytest.raises(ValueError, match="no complete export"):
        sources.read_export(spark, path)
    monkeypatch.undo()
    sources.export_delimited(exported, path)
    assert sources.read_export(spark, path).count() == 200
