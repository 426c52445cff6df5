"""op9 on lines that differ beyond the first characters of their words, and on lines without blanks."""

import random
from collections import defaultdict

from reliefgrid.llm import catalog


def dense_lines(rows):
    """The kept lines by brute force, by the shingles at every character."""
    at = [(i, k, x.strip()) for i, t in sorted(rows) for k, x in enumerate(t.split("\n")) if x.strip()]
    texts = list(dict.fromkeys(x for _, _, x in at))
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o >= 0.8 * (len(sets[a]) + len(sets[b]) - o):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    of, seen, kept = dict(zip(texts, group, strict=True)), set(), defaultdict(list)
    for i, k, x in at:
        if of[x] not in seen:
            seen.add(of[x])
            kept[i].append(k)
    return kept


def test_line_dedup_sees_every_character(spark, tmp_path):
    r = random.Random(9)
    run = lambda n: "".join(r.choice("abcdefghijklmnop汉字日本語") for _ in range(n))
    lines = ["Introduction", "Introductory", "Invoice number 2024000001", "Invoice number 2024111112", "short", "eightchr", "eightchs", "12345678", "汉字", "汉字日"]
    lines += [f"https://example.org/{run(40)}" for _ in range(8)]
    for _ in range(8):
        x = run(300)
        lines += [x, "#" + x[1:], x[:150] + "#" + x[151:], x + " " + run(4)]  # near copies, also of the first characters
    lines += [f"{run(30)} {run(30)} {run(30)}" for _ in range(5)]
    rows = list(enumerate(lines))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = {r.doc_id: r.kept_lines for r in catalog.QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}, dense_lines(rows)
    assert got == {k: want[k] for k, _ in rows}
    assert all(got[k] for k in range(18)) and sum(map(len, got.values())) < len(rows)
