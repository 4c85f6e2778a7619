import random

from pyspark.sql import functions as F

from vellum.operators import align, layout, splits

BOX = "page_id int, ord int, x1 int, y1 int, x2 int, y2 int"


def boxes(seed, pages=30):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for o in range(rng.randint(0, 12)):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((p, o, x, y, x + rng.randint(1, 40), y + rng.randint(1, 30)))
    return rows


def by_page(rows):
    out = {}
    for p, *r in rows:
        out.setdefault(p, []).append(r)
    return out


def test_reading_order_is_the_greedy_grouping(spark):
    rows = boxes(1)
    want = {}
    for p, own in by_page(rows).items():
        line, anchor = -1, None
        for o, _, y, *_ in sorted(own, key=lambda r: (r[2], r[0])):
            if anchor is None or y - anchor > 10:
                line, anchor = line + 1, y
            want[p, o] = line
    got = {(r["page_id"], r["ord"]): r["line"] for r in layout.reading_order(spark.createDataFrame(rows, BOX)).collect()}
    assert got == want


def test_suppression_keeps_the_larger(spark):
    rows = boxes(2)
    want = {}
    for p, own in by_page(rows).items():
        kept = []
        for _, *b in sorted(own):
            for i, k in enumerate(kept):
                w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
                area = [(c[2] - c[0]) * (c[3] - c[1]) for c in (b, k)]
                if max(w, 0) * max(h, 0) > 0.9 * min(area):
                    if area[0] > area[1]:
                        kept[i] = b
                    break
            else:
                kept.append(b)
        want[p] = kept
    got = {}
    for r in layout.suppressed(spark.createDataFrame(rows, BOX)).orderBy("page_id", "place").collect():
        got.setdefault(r["page_id"], []).append([r["x1"], r["y1"], r["x2"], r["y2"]])
    assert got == {p: k for p, k in want.items() if k}


def test_tall_boxes_are_tiled(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 0, 20, 10, 30), (1, 2, 0, 40, 10, 50), (1, 3, 0, 60, 10, 85), (1, 4, 0, 100, 10, 135)]
    got = layout.split_tall(spark.createDataFrame(rows, BOX)).orderBy("ord", "piece").collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["ord"], []).append((r["y1"], r["y2"]))
    assert [len(pieces[o]) for o in range(5)] == [1, 1, 1, 2, 4]  # 2.5 to 2, 3.5 to 4
    assert pieces[3] == [(60, 72), (72, 85)]
    for o, p in pieces.items():
        assert p[0][0] == rows[o][3] and p[-1][1] == rows[o][5] and all(a[1] == b[0] for a, b in zip(p, p[1:], strict=False))


def test_no_boxes(spark):
    none = spark.createDataFrame([], BOX)
    assert layout.reading_order(none).count() == layout.suppressed(none).count() == layout.merged_lines(none).count() == 0
    polygons = spark.createDataFrame([], "page_id int, ord int, poly array<int>")
    assert layout.line_boxes(polygons).count() == 0


def test_page_widths(spark):
    pages = spark.createDataFrame([(w, 500) for w in (349, 350, 450, 451, 500)], "width int, height int")
    count = lambda **o: {r["width"]: r["n"] for r in layout.split_pages(pages, **o).groupBy("width").agg(F.count("*").alias("n")).collect()}
    assert count(strict=True) == {349: 1, 451: 2, 500: 2}
    assert count() == {349: 1, 350: 1, 450: 1, 451: 2, 500: 2}
    assert count(by="aspect") == {349: 1, 350: 1, 450: 1, 451: 1, 500: 1}


def test_more_crops_than_lines(spark):
    crops = spark.createDataFrame([(1, i) for i in range(3)], "p int, c int")
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "p int, l int, text string")
    found, left = align.positional(crops, lines, ["p"], ["c"], ["l"])
    assert sorted((r["c"], r["text"]) for r in found.collect()) == [(0, "a"), (1, "b")]
    assert [r["c"] for r in left.collect()] == [2]


def test_splits_are_exact(spark):
    df = spark.range(101)
    parts = {r["split"]: r["count"] for r in splits.shuffled(df, ["id"], 7, 9, 10).groupBy("split").count().collect()}
    assert parts == {"train": 90, "test": 11}
    assert splits.head_tail(df, ["id"], 8, 10, lossy=True).count() == 100
    assert splits.with_replacement(df, ["id"], 50, 1).count() == 50
    assert splits.batched(df, ["id"], 16).select("batch").distinct().count() == 7
    one = df.select(splits.one_of(F.col("id"), 3, 9, 0.8).alias("t"))
    assert set(r["t"] for r in one.collect()) <= set(range(-1, 9))
