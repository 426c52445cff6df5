"""Rows of reports over line ends, against Python's own regular expressions on random reports."""

import random
import re

from reliefgrid.operators import reports as R

NAMES = ["八代市", "宇城市", "宇土市"]


def outage(text, name):
    m = re.search(rf"^\s*{name}\s+(約\s*[\d,.]+|[\d,.]+|不明)\s+(約\s*[\d,.]+|[\d,.]+(?:※)?|不明)\s+([^\s]+)(.*)$", text, re.MULTILINE)
    return m and (m[1], m[2], m[3], m[4].strip(" ・"), re.sub(r"\s+", " ", m[0]).strip())


def tankers(text, name):
    m = re.search(rf"^\s*{name}\s+([0-9\s]+)$", text, re.MULTILINE)
    return m and [int(x) for x in re.findall(r"\d+", m[1])]


def shelters(text):
    p = re.compile(R.SHELTER_ROW.replace("(?md)", ""), re.MULTILINE)
    return [(int(m[1]), m[2].strip(), m[3], int(m[4].replace(",", "")), int(m[11])) for m in p.finditer(text)]


def say(r, words, n):
    return "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", " \n ", "\n\n", "\t"]) for _ in range(n))


def test_random_reports(spark):
    r = random.Random(7)
    rows = []
    for k in range(400):
        body = say(r, [*NAMES, "約 5", "3,100", "不明", "7※", "8/3～", "断水", "12"], r.randint(0, 40))
        cars = say(r, [*NAMES, "1", "22", "3", "4", "なし"], r.randint(0, 40))
        rows.append((k, f"前置き\n■水道\n{body}\n○給水車の派遣状況\n{cars}\n■下水道\n八代市 9 9 9 9\n", body, cars))
    d = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, ""), (902, "■水道")], "report_id long, text string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, NAMES[0]]], "unit string")
    got = {(x.report_id, x.unit): x for x in R.outage_rows(d, names).collect()}
    want = {(k, n): m for k, t, *_ in rows for n in NAMES if (m := outage(t[t.find("■水道") : t.find("○給水車")], n))}
    assert got.keys() == want.keys() and len(want) > 50
    assert all((got[k].period, got[k].damage, got[k].raw_line) == want[k][2:] for k in want)
    cars = {(x.report_id, x.unit): x for x in R.tanker_rows(d, names).collect()}
    want = {(k, n): m for k, t, *_ in rows for n in NAMES if (m := tankers(t[t.find("給水車の") : t.find("■下水道")], n)) is not None}
    assert cars.keys() == want.keys() and len(want) > 100
    for k, v in want.items():
        x = cars[k]
        four = v if len(v) == 4 else [*v[:1], None, None, None] if v else [None] * 4
        assert [x.total, x.mlit, x.jwwa, x.sdf] == four
        assert x.parse_status == ("complete" if len(v) == 4 else "total only" if v else "unparsed")


def test_random_shelter_tables(spark):
    r = random.Random(8)
    rows = []
    for k in range(60):
        parts = []
        for i in range(r.randint(0, 5)):
            g = lambda: r.choice([" ", " ", "  ", "\n", " \n "])  # noqa: B023, E731
            parts.append(f"{g()}{i + 1}{g()}第{i} 校{g()}区{g()}1,{r.randint(100, 999)}{g()}3{g()}4{g()}〇{g()}△{g()}×{g()}5{g()}{i}{r.choice(['', ' ', '注'])}\n")
        rows.append((k, "番号 名称\n" + "".join(parts)))
    got = R.shelter_rows(spark.createDataFrame(rows, "report_id long, text string")).collect()
    found = sorted((x.report_id, x.shelter_number, x.shelter_name, x.district, x.capacity, x.portable_toilets) for x in got)
    assert found == sorted((k, *m) for k, t in rows for m in shelters(t)) and len(found) > 60


def test_rows_of_the_verdict(spark):
    text = "給水車の派遣状況\n八代市\n 6 3\n 2 1\n宇土市 4 1\n 2 1\n"
    got = R.tanker_rows(spark.createDataFrame([(1, text)], "report_id long, text string"), spark.createDataFrame([("八代市",), ("宇土市",)], "unit string")).collect()
    assert sorted((x.unit, x.total, x.mlit, x.jwwa, x.sdf, x.parse_status) for x in got) == [("八代市", 6, 3, 2, 1, "complete"), ("宇土市", 4, 1, 2, 1, "complete")]
