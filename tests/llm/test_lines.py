import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import lines
from larkspur.llm.queries import op6_lines
from tests.llm.data import edge_documents, edge_rows, no_documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, n):
    for _ in range(n):
        i, kind = r.randint(0, len(text)), r.choice("ids")
        text = text[:i] + ("" if kind == "d" else r.choice("abcxyzé🎉")) + text[i + (kind != "i") :]
    return text


def test_banded_distance():
    r = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        for k in range(4):
            assert lines.within(a, b, k) == (distance(a, b) <= k)


def test_linked_lines_share_a_key():
    r = random.Random(4)
    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(r.choice("abcdef é") for _ in range(r.randint(24, 50)))
            b = edited(r, a, r.randint(0, edits))
            key, row, own, sketch = lines.key_rows(["something else before", a, b], edits)
            one = {k: o for k, i, o in zip(key.tolist(), row.tolist(), own.tolist(), strict=True) if i == 1}
            assert any(i == 2 and k in one and (o or one[k]) for k, i, o in zip(key.tolist(), row.tolist(), own.tolist(), strict=True))
            s = dict(zip(row.tolist(), sketch.tolist(), strict=True))
            assert (s[1] ^ s[2]).bit_count() <= 4 * edits


def slow_classes(rows, edits=2, least=24):
    found = sorted(((d, i, t) for d, text in rows for i, t in lines.eligible(text, least)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    texts = list(dict.fromkeys(t for *_, t in found))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if abs(len(texts[i]) - len(texts[j])) <= edits and lines.within(texts[i], texts[j], edits):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    place, first = {t: i for i, t in enumerate(texts)}, {}
    for d, i, t in found:
        first.setdefault(find(place[t]), (d, i))
    return sorted(((d, i, *first[find(place[t])], first[find(place[t])] == (d, i)) for d, i, t in found), key=str)


def short_classes(rows, least=24):
    """Of the lines that are shorter and not blank: the first equal one."""
    found = sorted(((d, i, t) for d, text in rows for i, t in lines.eligible(text, 1) if len(t) < least), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    first = {}
    for d, i, t in found:
        first.setdefault(t, (d, i))
    return [(d, i, *first[t], first[t] == (d, i)) for d, i, t in found]


def compare(df, rows, **kw):
    got = [tuple(r) for r in lines.classes(df, **kw).select("doc_id", "line_no", "class_doc_id", "class_line_no", "keep").collect()]
    assert sorted(got, key=str) == slow_classes(rows, **kw)
    return got


def test_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = op6_lines(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(slow_classes(rows) + short_classes(rows), key=str)
    assert any(not r[4] for r in short_classes(rows))


def test_edges(spark):
    got = compare(edge_documents(spark), [r[:2] for r in edge_rows()])
    assert [g for g in got if g[0] is None] == [(None, 0, None, 0, True)]
    assert lines.classes(no_documents(spark)).count() == 0


def test_random_edits(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 70))) for _ in range(30)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randint(0, 4)) for _ in range(4))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compare(df, rows)
    compare(df, rows, edits=1, least=10)
    compare(df, rows, edits=3, least=30)


def test_dense_group(spark):
    """Many lines within a few edits of each other: verified as a group, not as pairs."""
    rows = [(i, f"page {i:05d} of the very same document") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_classes(rows)
    got = compare(df, rows)
    assert len({g[2] for g in got}) == len({w[2] for w in want})


def test_group_links_connect_what_pairs_connect():
    r = random.Random(8)
    for _ in range(10):
        texts = [edited(r, "a line of text that has many near copies", r.randint(0, 6)) for _ in range(60)]
        rows = [(lines.digest(t), t) for t in texts]
        edges = lines.group_links(rows, 2)
        by = dict(rows)
        root = {d: d for d in by}
        assert all(distance(by[a], by[b]) <= 2 for a, b in edges)
        assert len(edges) < len(by)
        for _ in by:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert len(set(root.values())) == len({x[2:4] for x in slow_classes(list(enumerate(dict.fromkeys(texts))), least=1)})


def test_hash_of_longs(spark):
    values = np.array([0, 1, -1, 1 << 40, -(1 << 50)], np.int64)
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i int, v long").select("i", F.pmod(F.xxhash64("v"), F.lit(lines.FILTER_BITS))).collect()
    assert [x[1] for x in sorted(rows)] == (lines._xxhash64_of_longs(values) % lines.FILTER_BITS).tolist()


def test_texts_without_repeated_lines(spark):
    long = "a line that is long enough to count"
    rows = [(1, f"{long}\nshort\n{long}"), (2, f"other\n{long}!\nshort"), (3, None), (4, ""), (5, long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, _id string")
    got = lines.deduplicate(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_id"}
    assert {r.doc_id: r.text for r in got} == {1: f"{long}\nshort", 2: "other\nshort", 3: None, 4: "", 5: ""}


def test_rows_without_or_with_one_id(spark):
    a, b, c = (f"{x} line that is long enough to count" for x in ("the first unique", "some other thing in a", "here is the last"))
    rows = [(None, f"{a}\n{b}\n{b}"), (None, f"x\ny\n{c}"), (None, f"z\n{b}"), (5, f"{a}\nu"), (5, f"{c}\nv"), (6, "v\nw")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in lines.deduplicate(df).collect())
    assert sum(t.split("\n").count(b) for t in got) == 1
    assert sorted(t.replace(f"\n{b}", "") for t in got) == sorted([a, f"x\ny\n{c}", "z", "u", "v", "v\nw"])
    assert sum(r.keep for r in lines.classes(df).collect()) == 3
    seven = f"{a}, seven\n{c}, seven"
    df = spark.createDataFrame([(7, f"{a}, seven\n{a}, seven"), (7, seven)], "doc_id long, text string")
    assert sum(t.count(f"{c}, seven") for t in (r.text for r in lines.deduplicate(df).collect())) == 1


def test_short_lines(spark):
    rows = [(1, "ab\nab\n\n x "), (2, "x\nabc\n \t"), (None, "x\nab"), (3, None), (4, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in lines.classes(df, short=True).collect()]
    assert sorted(got, key=str) == sorted(short_classes(rows), key=str)
    assert {r.doc_id: r.text for r in lines.deduplicate(df, short=True).collect()} == {None: "x\nab", 1: "\n".join([""]), 2: "abc\n \t", 3: None, 4: "\n\n"}
    assert {r.doc_id: r.text for r in lines.deduplicate(df).collect()} == dict(rows)


def test_names_of_columns(spark):
    text = "a line that is long enough to count"
    names = ("gone_", "_gone", "GONE__", "id_", "_id", "row_", "class", "keep", "line_no", "id", "row", "doc_id_")
    df = spark.createDataFrame([(1, text, *names), (2, text, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = lines.deduplicate(df).collect()
    assert sorted((r.doc_id, r.text, *r[2:]) for r in got) == [(1, text, *names), (2, "", *names)]


def test_second_keys_of_linked_lines():
    """Lines within the edits that share a first key share a second one too, and one of them as an own segment."""
    r = random.Random(14)
    for edits, least in ((1, 10), (2, 24), (3, 40)):
        for _ in range(300):
            a = "".join(r.choice("abcdef é") for _ in range(r.randint(least, 2 * least)))
            b = edited(r, a, r.randint(0, edits))
            if distance(a, b) == 0 or len(b) < least:
                continue
            key, row, own, _ = lines.key_rows([a, b], edits)
            one, two = ({k: o for k, i, o in zip(key.tolist(), row.tolist(), own.tolist(), strict=True) if i == n} for n in (0, 1))
            shared = [k for k in one if k in two and (one[k] or two[k])]
            assert shared
            for k in shared[:2]:
                key2, row2, own2, _ = lines.second_keys([a, b], np.array([k, k], np.uint64), edits)
                x, y = ({q: o for q, i, o in zip(key2.tolist(), row2.tolist(), own2.tolist(), strict=True) if i == n} for n in (0, 1))
                assert any(q in y and (x[q] or y[q]) for q in x)


def test_hot_segments(spark, monkeypatch):
    """A segment that most lines share, with few linked pairs: its lines are dealt again."""
    monkeypatch.setattr(lines, "MUCH", 1 << 10)
    r = random.Random(15)
    rows = []
    for i in range(150):
        tail = "".join(r.choice("abcdefghijkl") for _ in range(24))
        rows.append((2 * i, f"copyright notice {tail}"))
        rows.append((2 * i + 1, f"copyright notice {edited(r, tail, r.randint(0, 3))}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compare(df, rows)
    monkeypatch.setattr(lines, "LEADERS", 20)
    dense = [(i, f"page {i:05d} of the very same document") for i in range(300)]
    compare(spark.createDataFrame(dense, "doc_id long, text string"), dense)
