"""Queries without SQL, at the smallest scale, against plain Python over the same rows."""

from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from oracle import SF

from vellum.operators import kernels
from vellum.plans import registry

CONFUSED = str.maketrans("uvfs", "vusf")


def distance(a, b):
    """By rows of the table; what comes from the left is a running minimum."""
    b = np.array([hash(x) for x in b], dtype="i8")
    row, at = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != hash(x)))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


@pytest.fixture(scope="module")
def lines():
    rows = duckdb.execute(f"SELECT doc_id, lang, source, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    out = []
    for d, lang, source, text in rows:
        for i, t in enumerate(text.split("\n")):
            p = t.translate(CONFUSED)
            words = [[w for w in x.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w] for x in (t, p)]
            out.append({"doc": d, "no": i, "lang": lang, "source": source, "t": t, "p": p, "r": words[0], "w": words[1], "edits": 0 if words[0] == words[1] else distance(*words)})
    return out


def rows(spark, name, key):
    return {tuple(r[k] for k in key): r for r in registry.QUERIES[name](spark, SF).collect()}


def test_word_error_rates(spark, lines):
    by = defaultdict(list)
    for x in lines:
        by["s", x["source"]].append(x)
        by["l", x["lang"]].append(x)
    got = rows(spark, "wer_by_source", ["source"])
    assert len(got) == sum(k[0] == "s" for k in by)
    for (s,), r in got.items():
        own = by["s", s]
        assert (r["edits"], r["words"]) == (sum(x["edits"] for x in own), sum(len(x["r"]) for x in own))
        assert r["wer"] == r["edits"] / r["words"]
    for (lang,), r in rows(spark, "wer_per_char", ["lang"]).items():
        own = by["l", lang]
        assert abs(r["wer_per_char"] - sum(x["edits"] / len(x["r"]) / len(x["t"]) if x["r"] and x["t"] else 0 for x in own) / len(own)) < 1e-11
    for (lang,), r in rows(spark, "macro_means", ["lang"]).items():
        own = by["l", lang]
        assert r["n_lines"] == len(own)
        assert abs(r["wer"] - sum(x["edits"] / len(x["r"]) if x["r"] else 0 for x in own) / len(own)) < 1e-8
        assert 0 < r["cer"] < 1 and 0 < r["bleu"] < 1
    for (lang,), r in rows(spark, "metric_bundle", ["lang"]).items():
        own = by["l", lang]
        assert abs(r["wer"] - sum(x["edits"] for x in own) / sum(len(x["r"]) for x in own)) < 1e-12


def test_joined_batches(spark, lines):
    by = defaultdict(list)
    for x in sorted(lines, key=lambda x: (x["doc"], x["no"])):
        by[x["source"]].append(x)
    got = rows(spark, "joined_wer", ["source", "batch"])
    assert len(got) == sum(-(-len(v) // 8) for v in by.values())
    for (s, b), r in list(got.items())[:60]:
        own = by[s][b * 8 : b * 8 + 8]
        assert (r["edits"], r["words"]) == (distance([w for x in own for w in x["r"]], [w for x in own for w in x["w"]]), sum(len(x["r"]) for x in own))


def test_opcodes(spark, lines):
    words = {w for x in lines for w in x["r"]}
    got = {r["word"]: r["rate"] for r in registry.QUERIES["cer_opcode"](spark, SF).collect()}
    assert set(got) == words
    for w in sorted(words)[:300]:
        p = w.translate(CONFUSED)
        assert got[w] == sum(c[4] for c in SequenceMatcher(None, w, p).get_opcodes() if c[0] != "equal") / len(w)


def rasters():
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    return {v: np.clip(np.floor((np.array(e, dtype="f4").astype("f8") + 1) * 127.5), 0, 255).astype(int).reshape(8, 8) for v, e in rows}


def cleaned(px):
    """One pixel at a time."""
    h, w = px.shape
    at = lambda p, y, x: p[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    ink = np.array([[255 if px[y, x] <= np.mean([at(px, y + i, x + j) for i in range(-2, 3) for j in range(-2, 3)]) - 25 else 0 for x in range(w)] for y in range(h)])
    around = lambda p, f: np.array([[f(at(p, y + i, x + j) for i in (-1, 0) for j in (-1, 0)) for x in range(w)] for y in range(h)])
    ink = around(around(ink, max), min)
    label = kernels.labelled(ink > 0)
    for n in range(1, label.max() + 1):
        if (label == n).sum() < 2 or px[label == n].mean() > 128:
            ink[label == n] = 0
    out = 255 - ink
    out[0] = out[-1] = 255
    out[:, 0] = out[:, -1] = 255
    return out


def test_cleaning_and_transcription(spark):
    px = rasters()
    clean = {r["img_id"]: r["px"] for r in registry.QUERIES["page_clean"](spark, SF).collect()}
    assert clean.keys() == px.keys()
    own = {k: cleaned(v) for k, v in list(px.items())[:60]}
    for k, v in own.items():
        assert clean[k] == v.reshape(-1).tolist()
    pages = {r["page_id"]: r for r in registry.QUERIES["transcribed_pages"](spark, SF).collect()}
    for k, v in own.items():
        cuts = kernels.segment(v, least_band=0)
        want = ["".join(chr(97 + int(c) % 26) for c in (255 - v[a:b]).sum(0)) for a, b in cuts]
        assert (pages[k]["n_lines"], pages[k]["text"]) == (len(want), "\n".join(want))


def test_segments(spark):
    """A line ends where the cheapest way through a pale band does; found by trying all ways of short bands."""
    got = defaultdict(list)
    for r in registry.QUERIES["line_segments"](spark, SF).collect():
        got[r["img_id"]].append((r["line"], r["first_row"], r["end_row"]))
    for k, px in list(rasters().items())[:60]:
        spans = sorted(got[k])
        assert [s[0] for s in spans] == list(range(len(spans)))
        assert all(0 <= a < b <= 8 for _, a, b in spans)
        ink = px <= min(range(256), key=lambda t: (-spread(px, t), t))
        profile = ink.sum(1)
        low = profile < (profile.max() + profile.min()) / 2
        for y in range(8):  # rows with much ink are in a line
            assert low[y] or any(a <= y < b for _, a, b in spans)


def spread(px, t):
    """The variance between the classes up to t and above."""
    a, b = px[px <= t], px[px > t]
    return a.size * b.size * (a.mean() - b.mean()) ** 2 if a.size and b.size else 0.0


def test_line_boxes(spark):
    """Filter, split, snap, suppress, number: page by page with plain loops."""
    boxes = duckdb.execute(f"""SELECT l_orderkey, l_partkey % 700, (l_suppkey * 7 + l_linenumber * 13) % 900, 20 + l_quantity::BIGINT * 5, 10 + l_quantity::BIGINT % 17 * 4 FROM '{SF}/lineitem.parquet'""").fetchall()
    pages = defaultdict(list)
    for p, x, y, w, h in boxes:
        pages[p].append((x, y, x + w, y + h))
    got = defaultdict(list)
    for r in registry.QUERIES["line_boxes"](spark, SF).collect():
        got[r["page_id"]].append((r["line_no"], r["x1"], r["y1"], r["x2"], r["y2"]))
    for p, own in list(pages.items())[:400]:
        rects = []
        for i, (x1, y1, x2, y2) in enumerate(sorted(own), 1):
            s = x1 % 5
            xs, ys = (x1, x2, x2 - s, x1), (y1 + s, y1, y2, y2 - s)
            x, y, w, h = min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
            if w > 40 and y > 15 and y + h < 880:
                left = max(x - 20, 0)
                rects.append((i, left, y, left + min(w + 40, 900 - left), y + h))
        if rects:
            middle = float(np.median([(r[1] + r[3]) / 2 for r in rects]))
            rects = [r for r in rects if abs((r[1] + r[3]) / 2 - middle) < 200]
        pieces = []
        if rects:
            tall = float(np.median([r[4] - r[2] for r in rects]))
            for i, x1, y1, x2, y2 in rects:
                n = round((y2 - y1) / tall) if (y2 - y1) / tall > 1.6 else 1
                step = (y2 - y1) // n
                pieces += [(j > 0, i, j, x1, y1 + j * step, x2, y2 if j == n - 1 else y1 + (j + 1) * step) for j in range(n)]
            pieces.sort()
            a, b = int(np.median([q[3] for q in pieces])) - 30, int(np.median([q[5] for q in pieces])) + 20
        kept = []
        for q in pieces:
            new = (a, q[4], b, q[6])
            area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
            hit = next((k for k, r in enumerate(kept) if max(0, min(r[2], new[2]) - max(r[0], new[0])) * max(0, min(r[3], new[3]) - max(r[1], new[1])) > 0.9 * min(area(r), area(new))), None)
            if hit is None:
                kept.append(new)
            elif area(new) > area(kept[hit]):
                kept[hit] = new
        want = [(i, *r) for i, (_, r) in enumerate(sorted(enumerate(kept), key=lambda e: (e[1][1], e[0])), 1)]
        assert sorted(got[p]) == want, p
