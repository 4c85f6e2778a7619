"""Edge cases of each operator: nulls, empty and very long texts, ties, repeated rows, empty tables, columns that clash."""

import gzip
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from by_hand import lexicon_by_hand, score_by_hand, strength_by_hand
from pyspark.sql import functions as F

from vellum.llm import chat_format, embedding_dedup, fingerprint, license_scan, mixing, near_dedup, packing, textkit, toxicity, url_filter, warc
from vellum.llm import queries as Q
from vellum.llm.components import components

LONG = "wort " * 60_000
DOC = "doc_id long, text string, source string, bucket int, words int, key string, rank_ int, id int, label int, n_shingles int"
TEXTS = [(1, None), (2, ""), (3, "one"), (4, "A b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (7, LONG), (8, " \t\n"), (9, "Ünï 漢字 😀 \u0301x")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, None if i % 3 == 0 else f"s{i % 2}", i, i, "k", i, i, 0, 0) for i, (d, t) in enumerate(rows)], DOC)


# --- 1


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/7?x"), (4, "x://com/en/"), (4, "x://com/en/"), (None, "x://q.net/de/8#f"), (6, "x://example.net/de/8://y"), (7, "x://notcom/en/"), (8, "x://" + "a." * 5000 + "org/es/" + "p" * 5000), (9, "x://bad.org"), (10, "x://é.COM/EN/")],
        "page_id long, url string",
    ).withColumns({"key": F.lit("c"), "host": F.lit(1), "rule": F.lit(2), "p": F.lit(3), "w": F.lit(4)})
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, action string")
    listed = spark.createDataFrame([("bad.org",), (None,)], "rule string")
    got = sorted(((r["page_id"] or 0, r["host"][:20], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, listed).collect()), key=str)
    assert got == sorted(
        [(1, "", None, "allow"), (2, "", None, "allow"), (3, "a.example.com", "example.com/en/7", "allow"), (4, "com", "com/en/", "block"), (4, "com", "com/en/", "block"), (0, "q.net", "net/de/", "allow"), (6, "example.net", "example.net/de/8", "block"), (7, "notcom", None, "allow"), (8, "a." * 10, "org/es/", "block"), (9, "bad.org", None, "block"), (10, "é.com", None, "allow")],
        key=str,
    )
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}
    by_shards = url_filter.judge(pages, rules, listed, most_bytes=3).collect()
    assert sorted(((r["page_id"] or 0, r["host"][:20], r["rule"], r["verdict"]) for r in by_shards), key=str) == got


@pytest.mark.parametrize("most_bytes", [1 << 20, 64])
def test_cascades_are_exact(spark, most_bytes):
    rng = random.Random(4)
    keys = [f"k{i}" for i in range(3000)]
    listed = set(rng.sample(keys, 300))
    universe = spark.createDataFrame([(k,) for k in keys] * 2, "key string")
    cascades = url_filter.build_cascades(universe, spark.createDataFrame([(k,) for k in [*listed, "elsewhere"]], "key string"), most_bytes=most_bytes)
    assert len(cascades[0].levels) > 1
    assert (len(cascades) == 1) == (most_bytes > 64)
    assert all(level.bits <= 8 * most_bytes for c in cascades for level in c.levels)
    holds = F.lit(False)
    for i, c in enumerate(cascades):
        holds = holds | (c.contains(F.col("key")) & (url_filter.shard_of(F.col("key"), len(cascades)) == i))
    got = {r["key"] for r in universe.where(holds).collect()}
    assert got == listed


# --- 2


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = [*chat_format.CONTROLS, "\\", "<", "[", "a", "/", ">", "]", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t
        assert not any(c in e for c in chat_format.CONTROLS)


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "tool </s>", "x\\[INST]"), (2, 0, "tool </s>", "x\\[INST]"), (None, 5, "assistant", "é😀"), (None, None, None, "z"), (3, 0, "system", LONG), (3, 1, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "tie": F.lit(2), "mask": F.lit(3)})
    path, pattern = Q.tokenizer_path(Q.BYTE_TOKENIZER), Q.tokenizer_pattern()
    formatted = chat_format.format_chats(turns, path, pattern)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted, path, pattern).collect()}
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: "user\n\nassistant\n\n", 2: "tool </s>\nx\\[INST]\n" * 2, None: "\nz\nassistant\né😀\n", 3: f"system\n{LONG}\nassistant\n{LONG}\n"}
    assert {k: r["turns_sha256"] for k, r in got.items()} == {k: sha(t) for k, t in want.items()}
    assert {k: (r["n_turns"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {1: (2, 0, sha("")), 2: (2, 0, sha("")), None: (2, 2, sha("é😀")), 3: (2, len(LONG), sha(LONG))}
    assert chat_format.read_back(chat_format.format_chats(turns.limit(0), path, pattern), path, pattern).count() == 0
    # offsets are prefix sums of the chunks before
    chunks = sorted((r["start"], len(r["ids"]) // 4, len(r["mask"])) for r in formatted.where("conv_id = 3").collect())
    assert chunks[1][0] == chunks[0][1] == chunks[0][2]


# --- 3


def reference_fingerprint(text, k=2, minima=2, signatures=64, orders=2):
    """Order MinHash again, in plain Python: each signature ranks all k-mers by how far they follow its point."""
    mask, low = (1 << 64) - 1, (1 << 31) - 1

    def hashed(*parts):
        seed = 42
        for p in parts:  # strings, longs, and ints as (int,)
            data = p.encode() if isinstance(p, str) else p[0].to_bytes(4, "little") if isinstance(p, tuple) else (p & mask).to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = re.split("[ \t-\r]+", text)
    seen, keys = {}, []
    for i in range(len(w)):
        h = hashed(*w[i : i + k]) & ~low & mask
        n = seen[h] = seen.get(h, -1) + 1
        keys.append((hashed(h, (n,)) & ~low & mask if n else h, i))
    points = signatures // orders
    out = []
    for o in range(orders):
        ring = [(hashed(h, (o,)) & ~low & mask if o else h, i) for h, i in keys]
        for p in range(points):
            point = (p << 64) // points - (1 << 63)  # the ring begins with the smallest signed number
            first = sorted(ring, key=lambda x: ((signed(x[0]) - point) % (1 << 64), x[1]))[:minima]
            out.append(hashed(*[h >> 31 for h, _ in sorted(first, key=lambda x: (x[1], x[0]))]) & 0xFFFFFFFF)
    return out


def test_fingerprint_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "a b", "b a", "a a a a a", *[" ".join(rng.choice("abcdé") for _ in range(rng.randint(1, 80))) for _ in range(20)], *[" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (20, 100, 700)]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for orders in (1, 2, 8):
        df = fingerprint.with_fingerprint(frame, "text", "f", orders=orders)
        assert [r["f"] for r in df.collect()] == [reference_fingerprint(t, orders=orders) for t in texts]
    assert reference_fingerprint("a b c d e f") != reference_fingerprint("f e d c b a")
    other = fingerprint.with_fingerprint(frame, "text", "f", k=3, minima=3, signatures=16)
    assert [r["f"] for r in other.collect()] == [reference_fingerprint(t, 3, 3, 16) for t in texts]


def swapped_likeness(spark, n, **options):
    """The mean likeness of texts of n random words to themselves with their halves swapped."""
    rng = random.Random(n)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(40)]
    df = spark.createDataFrame([(" ".join(t), " ".join(t[n // 2 :] + t[: n // 2])) for t in texts], "a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "f", **options), "b", "g", **options)
    return df.agg(F.avg(fingerprint.likeness(F.col("f"), F.col("g")))).first()[0]


@pytest.mark.parametrize("n", [20, 40, 100])
def test_short_texts_keep_order(spark, n):
    """A pair stays in order if both its k-mers are in one half; of n k-mers one or two are new."""
    assert 0.25 < swapped_likeness(spark, n) < 0.55


@pytest.mark.parametrize("kind", ["bigint", "string", "int"])
def test_ranges_meet(spark, kind):
    """Whatever the ranges are, the next document by id, hash of the text and row follows."""
    rng = random.Random(8)
    rows = [(None if i % 5 == 0 else rng.randrange(40), f"t{rng.randrange(4)} x{i % 3}") for i in range(300)] + [(7, "the same")] * 100
    frame = spark.createDataFrame([(None if a is None else a, t) for a, t in rows], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    df, window = fingerprint.in_neighbourhoods(frame)
    got = df.withColumn("next_", F.lead(F.struct("doc_id", "tie_", "text")).over(window)).where("last_ = 0")
    assert got.select("range_").distinct().count() > 20
    key = lambda i, t: (i is not None, i if i is not None else 0, t)
    every = sorted(((r["doc_id"], r["tie_"], r["text"], r["next_"]) for r in got.collect()), key=lambda r: (key(r[0], r[1]), r[3] is not None and (r[3]["doc_id"], r[3]["tie_"]) != (r[0], r[1])))
    assert len(every) == 400
    for a, b in zip(every, every[1:] + every[:1], strict=True):
        assert (a[3]["doc_id"], a[3]["tie_"], a[3]["text"]) == b[:3]


def test_fingerprint_edges(spark):
    got = fingerprint.compare_edits(docs(spark).withColumns({"range_": F.lit(1), "next_": F.lit(2), "f": F.lit(3), "edited": F.lit(4)})).collect()
    assert len(got) == len(TEXTS)
    alike = [r for r in got if r["doc_id"] in (5, None)]
    assert len({r["fingerprint"] for r in alike}) == 1
    one = fingerprint.compare_edits(docs(spark, [(4, "abcd")])).first()
    assert (one["n_chars"], one["near_next"]) == (4, 1.0)
    assert fingerprint.compare_edits(docs(spark, [])).count() == 0


# --- 4


def test_toxicity_edges(spark):
    rows = [(i, f"this is {'idiot scum' if i % 3 == 0 else 'plain'} text number{i}", int(i % 3 == 0)) for i in range(200)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert {"idiot", "scum"} <= set(lexicon.weights)
    probe = ["an 1d10t", "an іdіоt", "idiots", "midiot", None, "", LONG, "IDIOT!"]
    got = [r["f"] for r in toxicity.score(docs(spark, list(enumerate(probe))), lexicon, flag_col="f").orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 0, 0, 0, 0, 1]
    lexicon.exceptions = ("idiot board",)
    assert toxicity.score(docs(spark, [(1, "the idiot board")]), lexicon).first()["toxic_flag"] == 0
    none = toxicity.fit(spark.createDataFrame([(1, "x", None), (2, None, 7)], "doc_id long, text string, label int"))
    assert toxicity.score(docs(spark), none).where("toxic_flag = 1").count() == 0
    assert toxicity.score(docs(spark, []), lexicon).count() == 0


def test_toxicity_by_brute_force(spark):
    """Counts, weights, matches and scores once more, in plain Python, without automaton or sums by task."""
    rng = random.Random(12)
    plain, bad = [f"word{i % 26 and chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)], ["idiot", "idiots", "scum", "scumbag", "vile"]
    rows = []
    for i in range(400):
        own = [rng.choice(plain) for _ in range(rng.randint(0, 60))]
        label = int(i % 5 == 0)
        own += [rng.choice(bad) for _ in range(rng.randint(1, 4))] if label else ["trash", "can"] * rng.randint(0, 1)
        rng.shuffle(own)
        rows.append((i, rng.choice([" ", ", ", " - "]).join(own).replace("i", rng.choice("i1і")), label))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.fit(frame)
    texts = {i: toxicity.folded(t) for i, t, _ in rows}
    labels = {i: y for i, _, y in rows}
    want = lexicon_by_hand(texts, labels)
    assert lexicon.weights.keys() == want.keys() and all(abs(lexicon.weights[t] - w) < 1e-9 for t, w in want.items())
    assert {"idiot", "scum", "vile"} == set(want)

    for r in toxicity.score(frame, lexicon).collect():
        s = strength_by_hand(texts[r["doc_id"]], want)
        assert abs(r["toxic_score"] - score_by_hand(s, lexicon)) < 1e-9
        assert r["toxic_flag"] == (r["toxic_score"] >= 0.3)


def test_sample_of_copies(spark):
    """60,000 copies of one text, a third of them toxic: the sample holds as many rows as it may, of both labels."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("scum and all that").alias("text"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    keys = rows.select(F.col("doc_id").cast("string").alias("id_"), F.xxhash64("text").alias("tie_"), "label")
    drawn = toxicity._drawn(keys.union(keys), 500)
    assert drawn.count() == 500 and 100 < drawn.where("label = 1").count() < 240
    lexicon = toxicity.fit(rows, most_rows=500)
    assert toxicity.score(docs(spark, [(1, "x")]), lexicon).count() == 1


def test_terms_that_reach_the_driver_are_bounded(spark):
    rows = [(i, f"idiot scum t{chr(97 + i % 7)}x plain{i}" if i % 2 else "plain", i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert len(toxicity.fit(frame, most_terms=6).weights) <= 6
    assert "scum" in toxicity.fit(frame, most_terms=6).weights


def test_columns_of_the_same_name_are_replaced(spark):
    frame = docs(spark).withColumns({"toxic_score": F.lit("old"), "toxic_flag": F.lit("old"), "license_words": F.lit("old"), "license_spans": F.lit("old"), "sequence_id": F.lit("old"), "offset": F.lit("old")})
    scored = toxicity.score(frame, toxicity.Lexicon())
    assert dict(scored.dtypes)["toxic_score"] == "double" and scored.columns.count("toxic_score") == 1 and scored.count() == len(TEXTS)
    scanned = license_scan.scan(frame)
    assert scanned.columns.count("license_words") == 1 and license_scan.summary(scanned).count() == len(TEXTS)
    pieces = packing.encode_pieces(frame, Q.tokenizer_path(Q.WORD_TOKENIZER)).drop("ids").withColumns({"sequence_id": F.lit("old"), "offset": F.lit("old"), "salt_": F.lit("kept"), "rank_": F.lit("kept")})
    placed = packing.pack(pieces)
    assert placed.columns.count("offset") == 1 and placed.where("salt_ = 'kept' and rank_ = 'kept' and offset >= 0").count() == len(TEXTS) + placed.where("piece > 0").count()


# --- 5


def test_words_that_clean_rows_share_are_kept(spark):
    """30 of 30 toxic and 10 of 1000 clean rows: log odds of 4.5, but less than four toxic rows a clean one."""
    rows = [(i, "scum here" if i < 40 else "plain here", int(i < 30)) for i in range(1030)]
    assert "scum" in toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int")).weights


def test_templates():
    s = license_scan.Scanner({"x": "use <<optional>>of <<any:1-2>><</optional>> in source", "y": "in <<any:0-1>> source"})
    places = lambda t: s.places(license_scan.split_words(t.encode()))
    assert places("Use in SOURCE") == [("x", 0, 3), ("y", 1, 3)]
    assert places("use of one two in source")[0] == ("x", 0, 6)
    assert [p for p in places("use of one two three in source") if p[0] == "x"] == []
    assert places("use, of ü in-source!")[0] == ("x", 0, 5)
    assert places("use in") == []
    with pytest.raises(ValueError):
        license_scan.Automaton.compiled("a <<optional>>b")
    with pytest.raises(ValueError):
        license_scan.Scanner({"z": "<<optional>>b<</optional>>"})


def spoken(template, rng):
    """A text that a template stands for: any words and optional regions drawn by lot, blanks and marks between."""
    t = re.sub(r"<<any:(\d+)-(\d+)>>", lambda m: " ".join(rng.choice(["Foo", "bar", "é1"]) for _ in range(rng.randint(int(m[1]), int(m[2])))), template)
    while (new := re.sub(r"<<optional>>((?:(?!<<).)*)<</optional>>", lambda m: rng.choice(["", m[1]]), t)) != t:
        t = new
    return "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ", ", "\n", ' "']) for w in t.split())


def test_whole_wordings(spark):
    """Each wording, as it may be written, has its label and 1; without one of its words, or with another, it hasn't."""
    rng = random.Random(6)
    rows, want = [], {}
    for name, t in license_scan.TEMPLATES.items():
        for i in range(6):
            while i > 3 and (bare := re.sub(r"<<optional>>(?:(?!<<(?:/?optional)).)*<</optional>>", "", t)) != t:
                t = bare
            text = spoken(t, rng)
            words = text.split()
            if i > 3:
                fixed = [j for j in range(2, len(words) - 2) if re.sub(r"\W", "", words[j]).lower() in ("software", "commons", "law", "license", "copy", "rights")]
                words[rng.choice(fixed)] = "" if i == 4 else "otherwise"
            want[len(rows)] = (name, i < 4)
            rows.append((len(rows), "Some words first. " + " ".join(words) + " and more"))
    got = {r["doc_id"]: r for r in license_scan.summary(license_scan.scan(docs(spark, rows))).collect()}
    for i, (name, whole) in want.items():
        spans = [x for x in got[i]["labels"].split(",")]
        assert (name in spans and got[i]["score"] == 1.0) if whole else got[i]["score"] < 1.0, (name, rows[i])


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "CC-BY cc by, all rights\nreserved"), (3, "general public license"), (None, LONG + "cc by"), (5, "Licensed under the Apache License, Version 2.0."), (6, "ccby all rights")]
    frame = docs(spark, rows).withColumn("license", F.lit(1))
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) for r in license_scan.summary(license_scan.scan(frame)).collect()]
    assert got == [(1, 0, 0, None, None, "", 0.0), (2, 0, 0, None, None, "", 0.0), (3, 7, 3, 0, 4, "cc-by,reserved", 0.5), (3, 3, 1, 0, 0, "gpl", 0.5), (None, 60002, 1, 60000, 60000, "cc-by", 0.5), (5, 8, 0, None, None, "apache-2.0", 0.8), (6, 3, 0, None, None, "", 0.0)]
    assert license_scan.scan(docs(spark, [])).count() == 0


# --- 6


def test_bins_hold_all_pieces():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([7, 30, 2048])
        histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        held = {}
        for count, contents in packing.plan_bins(histogram, capacity):
            assert count > 0 and sum(n * k for n, k in contents) <= capacity
            for n, k in contents:
                held[n] = held.get(n, 0) + k * count
        assert held == histogram


def test_packing_edges(spark):
    pieces = packing.encode_pieces(docs(spark), Q.tokenizer_path(Q.WORD_TOKENIZER), capacity=64)
    placed = packing.pack(pieces.drop("ids"), capacity=64)
    assert placed.count() == pieces.count() > len(TEXTS)
    spans = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("o"), F.count("*").alias("c"))
    assert spans.where("n <> end or n > 64 or o <> c").count() == 0
    assert packing.pack(pieces.limit(0), capacity=64).count() == 0
    whole = packing.sequences(pieces.where("doc_id in (3, 4)"), packing.pack(pieces.where("doc_id in (3, 4)"), capacity=64)).collect()
    assert len(whole) == 1 and np.frombuffer(whole[0]["ids"], "<u4").tolist().count(0) == 2


# --- 7


@pytest.mark.parametrize("lengths, dims", [(16, 256), (1, 3), (0, 3)])
def test_embeddings_by_brute_force(spark, monkeypatch, lengths, dims):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", lengths)
    monkeypatch.setattr(embedding_dedup, "DIMS", dims)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v.astype("f4")], int(i % 3)))
    rows += [(400 + i, rows[0][1], 0) for i in range(5)] + [(410, [x * 1e30 for x in rows[0][1]], 0)]
    odd = [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [float("nan")] * 8, 0), (504, [1.0] * 7 + [None], 0), (505, rows[0][1], None), (None, rows[0][1], 0), (506, [1.0, 0.0], 0), (507, [2.0, 0.0], 0), (508, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "many": F.lit(2), "cell_0": F.lit(3)})
    old = embedding_dedup.BLOCK, embedding_dedup.LEAF
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert old == (embedding_dedup.BLOCK, embedding_dedup.LEAF)
    real = [(i, np.array(v, "f4").astype("f8"), y) for i, v, y in rows] + [(506, np.array([1.0, 0]), 0), (507, np.array([2.0, 0]), 0)]
    up, links = {i: i for i, *_ in real}, {i: 0 for i, *_ in real}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, v, y) in enumerate(real):
        for j, w, z in real[n + 1 :]:
            if y == z and len(v) == len(w) and v / np.abs(v).max() @ (w / np.abs(w).max()) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(w / np.abs(w).max()) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    for i, *_ in real:
        assert got[i] == (links[i], root(i), root(i) == i)
    for i, *_ in odd:
        if i not in (506, 507):
            assert got[i] == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 8


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_duplicates_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 8)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [None, "", "\n", texts[0].upper(), LONG, LONG + "end"]
    frame = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, k=2).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 2, 80)


def test_near_duplicate_edges(spark):
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark), k=2).collect()}
    assert rows[4, 7] == (4, True) and rows[5, 7] == (4, False) and rows[None, 7] == (None, True) and rows[1, 0] == (1, True)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g h", "k l m n o p"
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b.upper()), (7, b), (None, a), (None, a), (8, ""), (8, ""), (9, None), (4, LONG), (2, LONG + "x"), (2, LONG + "x")]
    frame = docs(spark, rows).drop("bucket", "words", "rank_", "key").withColumns({"row": F.lit(1), "keep": F.lit(2), "digest": F.lit(3), "stays": F.lit(4), "id_": F.lit(5), "row_": F.lit(6)})
    got = near_dedup.deduplicated(frame, k=2)
    assert got.columns == frame.columns
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([(3, a), (5, b), (None, a), (None, a), (8, ""), (8, ""), (9, None), (4, LONG), (2, LONG + "x")], key=key)
    assert near_dedup.deduplicated(frame.limit(0)).count() == 0


def test_second_hub_meets_other_components_only(spark):
    bands = spark.createDataFrame([(1, x, 9) for x in (1, 2, 3, 4, 9)] + [(2, x, 7) for x in (5, 6, 7)], "key long, id long, far long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 1), (5, 5), (6, 5)], "node long, component long")
    left = near_dedup._open_groups(bands, labels)
    assert {r["key"]: (r["lead"], r["beyond"]) for r in left.collect()} == {1: (1, 1), 2: (5, 7)}
    assert sorted(map(tuple, near_dedup._far_pairs(left).collect())) == [(3, 9), (4, 9), (5, 7), (6, 7)]


def test_workers_keep_no_tables_of_other_operators():
    with open(Q.tokenizer_path(Q.WORD_TOKENIZER), "rb") as f:
        textkit.WordTokenizer.of(f.read())
    textkit._power(textkit._BASES[0], 10)
    textkit.released(tokenizers=False)
    assert not textkit._powers and textkit.WordTokenizer._own
    textkit.released()
    assert not textkit.WordTokenizer._own
    x, ends = near_dedup.shingle_sets(textkit.text_column(pa.array(["a b c"])), 2)
    assert len(x) == 2 and list(ends) == [0, 2]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 3000, dtype="u8"))
    parts = [x[:2000], x[500:3000], x]
    ends = np.cumsum([0, *map(len, parts)])
    r = near_dedup.registers(np.concatenate(parts), ends)
    assert (near_dedup.merged(r[0], r[1]) == r[2]).all()
    estimate = near_dedup.likeliest(r[:1], r[1:2], np.array([2000.0]), np.array([2500.0]))
    assert abs(estimate[0] - 0.5) < 0.15
    assert near_dedup.likeliest(r[:1], r[:1], np.array([2000.0]), np.array([2000.0]))[0] == 1


@pytest.mark.parametrize("chunk", [250_000, 5])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr("vellum.llm.components.CHUNK", chunk)
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


# --- 9


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 1000), ("1", 0)], "skey string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["0a"] == 20.0 and got["1"] == 0.0
    assert abs(got["0b"] - (3015 - 20) * 2 / 3) < 1e-9 and abs(got["0c"] - (3015 - 20) / 3) < 1e-9


def test_mixing_edges(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[1] == 0
    again = mixing.mix(docs(spark).repartition(3)).collect()
    key = lambda r: (r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


# --- 10


def test_salvage():
    make = lambda i, p: warc.record("response", i, f"http://x/{i}", warc.response_block(p), warc._digest(p), None, "2020-01-01T00:00:00Z")
    a, b, c = make(1, b"one"), make(2, b"WARC/1.0\r\nfoo"), make(3, b"three" * 100)
    ids = lambda data: [x["page_id"] for k, _, _, x in warc.salvage(data) if k == "record"]
    gaps = lambda data: [(s, e) for k, s, e, _ in warc.salvage(data) if k == "gap"]
    assert ids(a + b + c) == [1, 2, 3] and gaps(a + b + c) == []
    hurt = bytearray(a + b + c)
    hurt[len(a) + len(b) - 6] ^= 1  # in the payload of b: its digest fails
    assert ids(bytes(hurt)) == [1, 3] and gaps(bytes(hurt)) == [(len(a), len(a) + len(b))]
    assert ids(a + b"junk" + c[:50] + b"\n" + c) == [1, 3]
    assert ids(c[20:] + a) == [1] and gaps(c[20:] + a) == [(0, len(c) - 20)]
    assert ids(a + c[:-30]) == [1]
    members = [gzip.compress(x) for x in (a, b, c)]
    assert ids(b"".join(members)) == [1, 2, 3]
    broken = members[0] + members[1][: len(members[1]) // 2] + members[2]
    assert ids(broken) == [1, 3]
    assert gaps(broken) == [(len(members[0]), len(members[0]) + len(members[1]) // 2)]
    flipped = bytearray(b"".join(members))
    flipped[len(members[0]) + 40] ^= 255
    assert ids(bytes(flipped)) == [1, 3]
    assert ids(b"") == [] and ids(b"\0" * 100) == [] and gaps(b"\0" * 100) == [(0, 100)]


def test_salvage_inside_members():
    rng = random.Random(6)
    make = lambda i: warc.record("response", i, f"http://x/{i}", warc.response_block(p := rng.randbytes(3000)), warc._digest(p), None, "2020-01-01T00:00:00Z")
    records = [make(i) for i in range(1, 6)]
    lone = gzip.compress(make(9))
    ids = lambda data: [x["page_id"] for k, _, _, x in warc.salvage(data) if k == "record"]
    gaps = lambda data: [x for x in warc.salvage(data) if x[0] == "gap"]
    size = [len(x) for x in records]
    hurt = bytearray(b"".join(records))
    hurt[sum(size[:3]) - 100] ^= 1  # in the payload of the third
    member = gzip.compress(bytes(hurt))
    assert ids(member + lone) == [1, 2, 4, 5, 9]
    assert gaps(member + lone) == [("gap", 0, len(member), f"block digest at {sum(size[:2])} to {sum(size[:3])} of the member")]
    hurt[0] ^= 1
    assert ids(lone + gzip.compress(bytes(hurt))) == [9, 2, 4, 5]
    member = gzip.compress(b"".join(records))
    for level in (0, 6):  # stored bytes hold the version lines as they are
        member = gzip.compress(b"".join(records), level)
        cut = member[: len(member) * 7 // 10]
        assert ids(cut) == [1, 2, 3] and len(gaps(cut)) == 1
        assert ids(cut + lone) == [1, 2, 3, 9]
        assert ids(member[:-4] + b"abcd" + lone) == [1, 2, 3, 4, 5, 9]  # only the length in the trailer is wrong
    assert ids(cut + b"\n" + records[4]) == [1, 2, 3, 5]


def test_archives(spark, tmp_path):
    rows = [(3, "u\r\nv", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (7, "u", LONG), (7, "u", LONG), (8, "é", "WARC/1.1\r\n\r\n\x1f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha1": F.lit(2), "first": F.lit(3)})
    warc.write_archives(pages, f"{tmp_path}/w", file_records=2)
    read = warc.read_archives(spark, f"{tmp_path}/w")
    assert read.where("kind = 'gap'").count() == 0
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolved(read).collect())
    assert got == [(0, 4, "revisit", 1), (1, 4, "response", None), (2, 0, "response", None), (3, 4, "revisit", 1), (5, 0, "revisit", 2), (7, len(LONG), "response", None), (7, len(LONG), "response", None), (8, 13, "response", None)]
    warc.write_archives(pages, f"{tmp_path}/x", least_bytes=5)
    assert warc.resolved(warc.read_archives(spark, f"{tmp_path}/x")).where("record_type = 'revisit'").count() == 0
    warc.write_archives(pages.limit(0), f"{tmp_path}/y")
    assert warc.read_archives(spark, f"{tmp_path}/y").count() == 0
