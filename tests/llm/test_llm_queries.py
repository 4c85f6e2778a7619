"""The queries at the smallest scale: against their SQL, or the properties and brute-force versions that stand in for it."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from by_hand import copies_by_hand, lexicon_by_hand, score_by_hand, strength_by_hand
from oracle import SF, rows_of, sql_rows

from vellum.llm import queries as Q
from vellum.llm import toxicity


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    assert rows_of(Q.QUERIES[name](spark, SF)) == sql_rows(Q.ORACLES[name])


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}


def test_fingerprints_follow_edits(spark):
    texts = documents(spark)
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in Q.op3_document_fingerprints(spark, SF).collect()}
    assert sorted(rows) == ids
    seen = {}
    for i, d in enumerate(ids):
        t, n = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[d]["near_edited"] <= 1 and 0 <= rows[d]["near_next"] <= 1
        assert seen.setdefault(t, rows[d]["fingerprint"]) == rows[d]["fingerprint"]
    long = [r for d, r in rows.items() if len(texts[d]) > 500]
    assert sum(r["near_edited"] for r in long) > 3 * sum(r["near_next"] for r in long)


def test_toxicity_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in Q.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in Q.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
    own = [(rows[d]["predicted"], y) for d, y in labels.items() if rows[d]["held_out"]]
    assert sum(p == y for p, y in own) / len(own) > 0.9


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path(Q.WORD_TOKENIZER))
    texts = documents(spark)
    ids = {d: [*e.ids, 0] for d, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    rows = Q.op6_best_fit_packing(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(own) <= 2048
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    assert {d: sum(r["length"] for r in own) for d, own in by_doc.items()} == {d: len(i) for d, i in ids.items()}
    assert all(sorted(r["piece"] for r in own) == list(range(-(-len(ids[d]) // 2048))) for d, own in by_doc.items())
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= sum(len(i) for i in ids.values()) / 2048 * 1.03 + 1


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = Q.table(spark, SF, "documents")
    seen = [docs.cache()]
    for _, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    texts = documents(spark)
    clean, single, mixed, packed = (s.collect() for s in seen[1:])
    for s in seen[1:-1]:
        assert s.columns == docs.columns
    # toxicity: the lexicon and every score by hand
    labels = {r["doc_id"]: r["toxic"] for r in Q.table(spark, SF, "labels").collect()}
    folded = {d: toxicity.folded(t) for d, t in texts.items()}
    taught = {d: y for d, y in labels.items() if d in texts and zlib.crc32(str(d).encode()) % 4 != 2}
    lexicon = toxicity.fit_on(docs, Q.table(spark, SF, "labels"))
    want = lexicon_by_hand({d: folded[d] for d in taught}, taught)
    assert lexicon.weights.keys() == want.keys() and want
    kept = {r["doc_id"] for r in clean}
    assert kept == {d for d, t in folded.items() if score_by_hand(strength_by_hand(t, want), lexicon) < 0.3}
    assert 0.8 * len(texts) < len(kept) < len(texts)
    # near duplicates by brute force
    sets = {}
    for d in kept:
        w = texts[d].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\n", " ").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in kept}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(kept)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in single} == {d for d in kept if root(d) == d}
    # the mix by hand
    times = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixed)
    taken = copies_by_hand([(r["doc_id"], r["source"], len(r["text"].split())) for r in single])
    assert times == Counter({r: n for r, n in taken.items() if n})
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
