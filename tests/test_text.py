import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import names
from vellum.functions import text as T
from vellum.functions import tokens as K
from vellum.operators import metrics


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(col.alias("x")).first()["x"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_edits(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    pairs += [([str(i) for i in range(400)], [str(i) for i in range(1, 400)]), ([], []), (["ñ", "😀"], ["n"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r["d"] for r in df.select(T.word_edits(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [distance(a, b) for a, b in pairs]


def test_cleaning(spark):
    assert one(spark, T.without_punctuation(F.col("t")), t="a.b,c!d") == "abcd"
    assert one(spark, T.stripped(F.col("t")), t=" \t a b\n") == "a b"
    assert one(spark, T.tokens(F.col("t")), t="  a  b\tc ") == ["a", "b", "c"]
    assert one(spark, T.lines(F.col("t")), t="a\nb\n") == ["a", "b", ""]
    assert one(spark, T.lines(F.col("t"), keep_last_empty=False), t="a\nb\n") == ["a", "b"]
    assert one(spark, T.clean_label(F.col("t")), t="word_rot-3_gauss") == "word"
    assert one(spark, T.unknown_to_space(F.col("t")), t="[UNK]a[UNK]b[UNK]") == "a b"
    assert one(spark, T.modern_spelling(F.col("t")), t="çaça q̃ cõde niño") == "zaza que conde niño"
    assert one(spark, T.match_key(F.col("t")), t="Vfſa") == "ussa"


def test_line_numbers(spark):
    assert one(spark, names.line_number(F.col("f")), f="p_line_3_2.png") == [3, 2]
    assert one(spark, names.line_number(F.col("f")), f="p.png") == [-1]
    assert one(spark, names.number_before(F.col("f"), ".jpg"), f="12.jpg") == 12
    assert one(spark, names.number_before(F.col("f"), ".jpg"), f="x") == -1
    assert one(spark, names.stem(F.col("f")), f="a.b/c.txt") == "a.b/c"


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abcxyzé", max_size=30))
def test_encode_decode(spark, label):
    vocab = F.create_map(*[x for i, c in enumerate("abcxyzé") for x in (F.lit(c), F.lit(10 + i))])
    ids = one(spark, K.encoded_with_end(F.col("t"), vocab, unknown=3, end=1, pad=2), t=label)
    assert len(ids) == 21
    back = "".join("abcxyzé"[i - 10] for i in ids if i >= 10)
    assert back == label.lower()[:20]
    assert ids[len(back)] == 1 and set(ids[len(back) + 1 :]) <= {2}


def test_empty_reference(spark):
    df = spark.createDataFrame([("", "x", 1), ("ab", "ab", 1)], "r string, p string, g int")
    r = metrics.corpus_cer(df, "r", "p", ["g"]).first()
    assert (r["edits"], r["chars"], r["cer"]) == (1, 2, 0.5)
    assert metrics.corpus_wer(df.where("r = ''"), "r", "p", ["g"]).first()["wer"] == 0.0


def test_repeats_and_until(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2],), ([1, 2, 3],), ([],), ([9, 1],)], "a array<int>")
    assert [r[0] for r in df.select(K.repeats_ngram(F.col("a"), 2)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(K.until(F.col("a"), 9)).collect()] == [[1, 2, 3, 1, 2], [1, 2, 3], [], []]


def test_opcode_rate(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", "x"), ("ab", "ab")], "r string, p string")
    assert [r["rate"] for r in metrics.opcode_rate(df, "r", "p").collect()] == [0.75, 1.0, 0.0]
