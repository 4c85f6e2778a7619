"""Transcription, metrics, file names, alignment, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import tokens as K
from ..functions.ranges import numbered
from ..operators import align, logs, metrics, splits
from .registry import query
from .standins import SQL_BYTES, SQL_LINES, SQL_RECOGNISED, lines, read, recognised

_LEV = f"levenshtein({SQL_BYTES.format('text')}, {SQL_BYTES.format(SQL_RECOGNISED.format('text'))})"
_PAIRS = f"(SELECT *, {SQL_RECOGNISED.format('text')} AS pred, {_LEV} AS edits FROM {SQL_LINES})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with predictions, dealt out evenly: a distance costs the square of its line, far more than moving the line."""
    return lines(spark, sf_dir).repartition("doc_id", "line_no").withColumn("pred", recognised(F.col("text")))


@query(f"SELECT lang, count(*) AS n_lines, sum(edits)::BIGINT AS edits, sum(length(text))::BIGINT AS chars, sum(edits)::BIGINT / sum(length(text))::BIGINT AS cer FROM {_PAIRS} GROUP BY lang")
def cer_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_cer(scored(spark, sf_dir), "text", "pred", ["lang"])


@query(f"SELECT source, count(*) AS n_lines, round(avg(CASE WHEN length(text) > 0 THEN edits / length(text) ELSE 0 END), 9) AS cer FROM {_PAIRS} GROUP BY source")
def cer_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_cer(scored(spark, sf_dir), "text", "pred", ["source"])


@query(f"SELECT lang, count(*) AS n, sum((text = pred)::INT)::BIGINT AS matches, sum((text = pred)::INT)::BIGINT / count(*) AS accuracy FROM {_PAIRS} GROUP BY lang")
def exact_match_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exact_matches(scored(spark, sf_dir), "text", "pred", ["lang"])


@query()
def wer_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_wer(scored(spark, sf_dir), "text", "pred", ["source"])


@query()
def wer_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word error rate divided by the number of characters; not a character error rate."""
    return metrics.wer_per_char(scored(spark, sf_dir), "text", "pred", ["lang"])


@query(f"""
WITH n AS (SELECT lang, doc_id, line_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS rn, edits, length(text) AS chars FROM {_PAIRS}),
b AS (SELECT lang, rn // 32 AS batch, sum(edits) / greatest(sum(chars), 1) AS cer FROM n GROUP BY ALL)
SELECT lang, count(*) AS batches, round(avg(cer), 9) AS batch_cer FROM b GROUP BY lang""")
def batch_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of batches' error rates, which isn't the corpus's."""
    return metrics.batch_cer(scored(spark, sf_dir), "text", "pred", "lang", ["doc_id", "line_no"], 32)


def _grams(name: str, n: int) -> str:
    return f"""g{n} AS (SELECT source, doc_id, line_no, 0 AS side, array_to_string(r[i : i + {n - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(r) - {n - 2})) AS i FROM w)
  UNION ALL SELECT source, doc_id, line_no, 1, array_to_string(p[i : i + {n - 1}], ' ') FROM (SELECT *, unnest(range(1, len(p) - {n - 2})) AS i FROM w)),
c{n} AS (SELECT source, sum(least(a, b))::BIGINT AS hits, sum(b)::BIGINT AS all_ FROM (SELECT source, doc_id, line_no, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g{n} GROUP BY ALL) GROUP BY source)"""


@query(f"""
WITH w AS (SELECT source, doc_id, line_no, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> '') AS r,
  list_filter(string_split_regex({SQL_RECOGNISED.format('text')}, '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> '') AS p FROM {SQL_LINES}),
{', '.join(_grams('g', n) for n in (1, 2, 3, 4))},
l AS (SELECT source, sum(len(r))::BIGINT AS ref_words, sum(len(p))::BIGINT AS pred_words FROM w GROUP BY source)
SELECT source, ref_words, pred_words, round(CASE WHEN least(c1.hits, c2.hits, c3.hits, c4.hits) > 0 THEN
  CASE WHEN pred_words >= ref_words THEN 1 ELSE exp(1 - ref_words / pred_words) END * exp((ln(c1.hits / c1.all_) + ln(c2.hits / c2.all_) + ln(c3.hits / c3.all_) + ln(c4.hits / c4.all_)) / 4) ELSE 0 END, 9) AS bleu
FROM l JOIN c1 USING (source) JOIN c2 USING (source) JOIN c3 USING (source) JOIN c4 USING (source)""")
def bleu4_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_bleu(scored(spark, sf_dir), "text", "pred", ["source"])


@query(f"SELECT doc_id, line_no::INT AS line_no, round(CASE WHEN length(text) > 0 THEN 1 - edits / length(text) ELSE 1 END, 9) AS alike, round(CASE WHEN length(text) > 0 THEN edits / length(text) ELSE 0 END, 9) AS apart FROM {_PAIRS}")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = T.similarity_pair(F.col("text"), F.col("pred"))
    return scored(spark, sf_dir).select("doc_id", "line_no", pair.alias("s")).select("doc_id", "line_no", F.round(F.get("s", F.lit(0)), 9).alias("alike"), F.round(F.get("s", F.lit(1)), 9).alias("apart"))


@query()
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_means(scored(spark, sf_dir), "text", "pred", ["lang"])


@query()
def joined_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight lines, each as one text."""
    return metrics.joined_wer(scored(spark, sf_dir), "text", "pred", "source", ["doc_id", "line_no"], 8)


@query()
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bundle(scored(spark, sf_dir), "text", "pred", ["lang"])


@query()
def cer_opcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each different word."""
    words = read(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return metrics.opcode_rate(words.withColumn("pred", recognised(F.col("word"))), "word", "pred")


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query(f"SELECT doc_id, length(translate(text, '{_PUNCT}', '')) AS n_chars, md5(translate(text, '{_PUNCT}', '')) AS digest FROM documents")
def punctuation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.without_punctuation(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, line_no::INT AS line_no, split_part(split_part(text || '_rot3_gauss', '_', 1), ' ', 1) AS label FROM {SQL_LINES}")
def label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", T.clean_label(F.concat("text", F.lit("_rot3_gauss"))).alias("label"))


@query(f"""WITH m AS (SELECT lang, translate(lower(word), 'vf', 'us') AS key, count(DISTINCT word) AS spellings, count(*) AS n FROM (
  SELECT lang, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY ALL)
SELECT lang, key, spellings, n FROM m WHERE spellings > 1""")
def interchangeable_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which several spellings of a word meet."""
    words = read(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))  # the vocabulary; all that follows is small
    return counted.groupBy("lang", T.match_key(F.col("word")).alias("key")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")).where("spellings > 1")


@query(f"SELECT doc_id, line_no::INT AS line_no, translate(text, 'çÇ', 'zZ') AS text FROM {SQL_LINES}")
def orthography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", T.modern_spelling(F.col("text")).alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN text || '-' ELSE text END AS text FROM {SQL_LINES}),
g AS (SELECT *, sum(CASE WHEN prev LIKE '%-' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM l))
SELECT doc_id, part::BIGINT AS part, md5(string_agg(CASE WHEN text LIKE '%-' THEN left(text, -1) ELSE text END, '' ORDER BY line_no)) AS digest FROM g GROUP BY doc_id, part""")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyphened = lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 3 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return align.dehyphenated(hyphened, "doc_id", "line_no").select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.character_counts(read(spark, sf_dir, "documents"), "text")


@query("SELECT lang, max(length(w))::INT AS most FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang")
def max_label_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("lang").agg(F.max(F.length("w")).alias("most"))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_WORDS = "(SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("w"))
    return w.where("w <> ''").select(F.lower("w").alias("w")).distinct()


def _vocab(first: int):
    return F.create_map(*[x for i, c in enumerate(_ALPHABET) for x in (F.lit(c), F.lit(first + i))])


@query(f"""SELECT w, array_to_string(list_concat(list_transform(list_filter(string_split(w, ''), lambda c: c <> ''), lambda c: instr('{_ALPHABET}', c)::INT),
  list_transform(range(greatest(24 - length(w), 0)), lambda i: 27)), ' ') AS ids FROM {_WORDS}""")
def oov_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters to ids, 0 for unknown ones, padded with one more than the classes."""
    ids = K.padded(K.encoded(T.characters(F.col("w")), _vocab(1), 0), 24, len(_ALPHABET) + 1)
    return _words(spark, sf_dir).select("w", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(f"""SELECT w, array_to_string(list_concat(list_concat(list_transform(list_filter(string_split(left(w, 20), ''), lambda c: c <> ''), lambda c: CASE WHEN instr('{_ALPHABET}', c) > 0 THEN instr('{_ALPHABET}', c)::INT + 3 ELSE 3 END), [1]),
  list_transform(range(20 - least(length(w), 20)), lambda i: 2)), ' ') AS ids FROM {_WORDS}""")
def eos_pad_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = K.encoded_with_end(F.col("w"), _vocab(4), unknown=3, end=1, pad=2)
    return _words(spark, sf_dir).select("w", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(f"SELECT w, regexp_replace(left(w, 20), '[^a-z]', '?', 'g') AS decoded FROM {_WORDS}")
def decode_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to ids and back: the first 20 characters, unknown ones as a mark, and nothing of what stands for end and padding."""
    ids = K.encoded_with_end(F.col("w"), _vocab(4), unknown=3, end=1, pad=2)
    shown = F.create_map(F.lit(3), F.lit("?"), F.lit(1), F.lit("<EOS>"), F.lit(2), F.lit("<PAD>"), *[x for i, c in enumerate(_ALPHABET) for x in (F.lit(4 + i), F.lit(c))])
    whole = F.array_join(F.transform(ids, lambda i: F.try_element_at(shown, i)), "")
    return _words(spark, sf_dir).select("w", K.cut_at_markers(whole, "<PAD>", "<EOS>").alias("decoded"))


@query(f"SELECT doc_id, line_no::INT AS line_no, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> ''))::INT AS n_words, length(trim(text, ' \t\n\r' || chr(11) || chr(12)))::INT AS n_chars FROM {SQL_LINES}")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", F.size(T.tokens(F.col("text"))).alias("n_words"), F.length(T.stripped(F.col("text"))).alias("n_chars"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS by_split, (len(string_split(text, chr(10))) - (text LIKE '%' || chr(10))::INT)::INT AS by_lines FROM documents")
def line_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting at line ends counts an empty last line, reading lines doesn't."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.lines(t)).alias("by_split"), F.size(T.lines(t, keep_last_empty=False)).alias("by_lines"))


@query("SELECT doc_id, (length(text) - length(replace(text, ';', '')))::INT AS marks, (length(text) - length(replace(text, '.', '')))::INT AS stops FROM documents")
def count_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.count_of(F.col("text"), ";").alias("marks"), T.count_of(F.col("text"), ".").alias("stops"))


# --- file names and orders


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    name = F.concat(F.lit("page_"), "doc_id", F.when(n % 5 == 4, F.lit("_scan.png")).otherwise(F.concat(F.lit("_line_"), n, F.when(n % 4 == 3, F.concat(F.lit("_"), n % 7)).otherwise(""), F.lit(".png"))))
    return lines(spark, sf_dir).select("doc_id", name.alias("file"))


_SEGMENTS = f"""(SELECT doc_id, 'page_' || doc_id || CASE WHEN line_no % 5 = 4 THEN '_scan.png' ELSE '_line_' || line_no || CASE WHEN line_no % 4 = 3 THEN '_' || (line_no % 7) ELSE '' END || '.png' END AS file FROM {SQL_LINES})"""
_NUMBER = "regexp_extract(file, '_line_(\\d+(_\\d+)?)\\.png$', 1)"


@query(f"SELECT doc_id, file, CASE WHEN {_NUMBER} = '' THEN '-1' ELSE {_NUMBER} END AS line, (file LIKE 'page_%' AND file LIKE '%\\_line\\_%' ESCAPE '\\' AND file LIKE '%.png') AS is_segment FROM {_SEGMENTS}")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file")
    return _segments(spark, sf_dir).select("doc_id", "file", F.array_join(N.line_number(f).cast("array<string>"), "_").alias("line"), N.is_segment(f, F.lit("page_")).alias("is_segment"))


@query(f"""WITH k AS (SELECT doc_id, file, CASE WHEN {_NUMBER} = '' THEN [-1] ELSE list_transform(string_split({_NUMBER}, '_'), lambda x: x::INT) END AS k FROM {_SEGMENTS})
SELECT doc_id, file, row_number() OVER (PARTITION BY doc_id ORDER BY k, file)::INT AS place FROM k""")
def hier_line_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir)
    return s.select("doc_id", "file", F.row_number().over(Window.partitionBy("doc_id").orderBy(N.line_number(F.col("file")), "file")).alias("place"))


@query("SELECT page_id, coalesce(try_cast(regexp_extract(url, '(\\d+)\\.html', 1) AS BIGINT), -1) AS key FROM pages")
def sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", N.number_before(F.col("url"), ".html").alias("key"))


@query("SELECT doc_id || '_' || lang || '.jpg' AS \"FILENAME\", doc_id || '_' || lang AS \"IDENTITY\" FROM documents WHERE source <> 'src0'")
def csv_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(F.concat_ws("_", "doc_id", "lang").alias("s"), F.when(F.col("source") == "src0", ".png").otherwise(".jpg").alias("e"))
    return N.labelled_files(files.select(F.concat("s", "e").alias("file")), "file", skip=(".png",))


@query("SELECT lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def count_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


# --- pages, joins, alignment


@query("""WITH c AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations)
SELECT conv_id, page::BIGINT AS page, md5(string_agg(trim(text, ' ' || chr(10)), chr(10) ORDER BY turn)) AS digest FROM c WHERE role <> 'user' AND page > 0 AND trim(text, ' ' || chr(10)) <> '' GROUP BY conv_id, page""")
def marker_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.btrim("text", F.lit(" \n")))
    pages = align.pages_between_markers(turns, "conv_id", "turn", F.col("role") == "user", "text")
    return pages.select("conv_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id, count(*) AS n_lines, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = align.page_text(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return pages.select("conv_id", "n_lines", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH g AS (SELECT *, sum((role IS DISTINCT FROM prev)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations))
SELECT conv_id, line::BIGINT AS line, min(turn) AS first_turn, count(*) AS n FROM g GROUP BY conv_id, line""")
def line_change_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = align.runs(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "line")
    return runs.groupBy("conv_id", "line").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT source, doc_id, 1 + (doc_id % 4) AS n FROM documents), o AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS lo FROM s),
l AS (SELECT source, doc_id AS line_doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line FROM documents)
SELECT o.source, o.doc_id AS page, l.line, l.line_doc FROM o JOIN l ON l.source = o.source AND l.line >= o.lo AND l.line < o.lo + o.n""")
def running_offset_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", "doc_id")
    pages = docs.select("source", F.col("doc_id").alias("page"), (1 + F.col("doc_id") % 4).alias("n"))
    own = numbered(docs, ["doc_id"], ["source"]).select("source", F.col("doc_id").alias("line_doc"), F.col("i_").alias("line"))
    return align.by_running_offset(pages, own, "source", "page", "n", "line").select("source", "page", "line", "line_doc")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".jpg")).alias("file"), "doc_id", "lang")
    texts = read(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(".txt")).alias("file"), "quality")
    return align.by_stem(images, texts, "file").select("doc_id", "lang", "quality")


_CROPS = "(SELECT conv_id AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn FROM conversations)"
_PAGE_LINES = f"(SELECT doc_id AS page, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, text FROM {SQL_LINES})"


def _crops_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn"), lines(spark, sf_dir).select(F.col("doc_id").alias("page"), "line_no", "text")


@query(f"SELECT page, c.turn, l.n::INT AS n, md5(l.text) AS digest FROM {_CROPS} c JOIN {_PAGE_LINES} l USING (page, n)")
def positional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops, texts = _crops_and_lines(spark, sf_dir)
    found, _ = align.positional(crops, texts, ["page"], ["turn"], ["line_no"])
    return found.select("page", "turn", "n", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT page, c.turn, c.n::INT AS n FROM {_CROPS} c ANTI JOIN {_PAGE_LINES} l USING (page, n)")
def align_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops, texts = _crops_and_lines(spark, sf_dir)
    return align.positional(crops, texts, ["page"], ["turn"], ["line_no"])[1].select("page", "turn", "n")


@query(f"SELECT page, least(max(a), max(b))::INT AS n FROM (SELECT page, count(*) AS a, 0 AS b FROM {_CROPS} GROUP BY page UNION ALL SELECT page, 0, count(*) FROM {_PAGE_LINES} GROUP BY page) GROUP BY page HAVING least(max(a), max(b)) > 0")
def zip_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops, texts = _crops_and_lines(spark, sf_dir)
    return align.zipped(crops, texts, "page", "turn", "line_no").select("page", F.size("pairs").alias("n"))


@query("""SELECT word, doc_id, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id DESC, pos DESC) AS r FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)) WHERE r = 1""")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return align.last_wins(words, ["word"], ["doc_id", "pos"]).select("word", "doc_id", "pos")


@query("SELECT turn, conv_id, 100 + row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM conversations")
def renumber_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all folders under one running number, from where the last run ended."""
    return align.renumbered(read(spark, sf_dir, "conversations").select("turn", "conv_id"), ["conv_id", "turn"], 100)


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn // 2, turn) + 6 AS number, (row_number() OVER (ORDER BY conv_id, turn // 2, turn) + 6) || ';' || (turn // 2) || '.png' AS file FROM conversations")
def numbered_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words a line; numbers run on over all pages, from where the last ones ended."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("line"))
    return align.crop_names(words, "conv_id", "line", ["turn"], 7).select("conv_id", "turn", "number", "file")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def books_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.in_both(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations)
SELECT i // 8 AS chunk, count(*) AS n, string_agg(role, ' ' ORDER BY i) AS words FROM n WHERE i < n // 10 GROUP BY 1""")
def words_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of predicted words, eight to a line."""
    own = align.chunked(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 8, 1, 10)
    words = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role"))), lambda x: x["role"])
    return own.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(words, " ").alias("words"))


@query("SELECT source, count(*) AS n, (ceil(count(*) / 16) * 16)::BIGINT AS padded FROM documents GROUP BY source")
def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", logs.padded_size(F.col("n"), 16).cast("long").alias("padded"))


@query("SELECT source, (max(doc_id) + row_number() OVER (ORDER BY source))::BIGINT AS next FROM documents GROUP BY source")
def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where renumbered copies of each source would go on."""
    top = read(spark, sf_dir, "documents").groupBy("source").agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("top"))
    return top.select("source", (F.col("top") + F.row_number().over(Window.orderBy("source"))).cast("long").alias("next"))


# --- splits and augmentation

_RN = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents"


@query(f"SELECT doc_id, CASE WHEN i < n * 8 // 10 THEN 'train' ELSE 'test' END AS split FROM ({_RN}) WHERE i <> n * 8 // 10")
def split_8020_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at the border is in neither part."""
    return splits.head_tail(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 8, 10, lossy=True)


@query(f"SELECT doc_id, CASE WHEN i < n * 9 // 10 THEN 'train' ELSE 'val' END AS split FROM ({_RN})")
def split_9010_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head_tail(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 9, 10, names=("train", "val"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 10")
def random_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files by lot: drawing so many is what it does."""
    return splits.drawn(read(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 10, 7)


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def tail_pages_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.last_of(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 2)


@query("SELECT batch, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) GROUP BY batch")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = splits.batched(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 16)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, doc_id || CASE WHEN a = 0 THEN '' ELSE '_rot' || a END || g || '.png' AS file FROM documents, (SELECT unnest(range(-5, 6)) AS a), (VALUES (''), ('_gauss')) AS t(g)")
def augment_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.augmented_names(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


@query("SELECT doc_id, v::INT AS variant, doc_id || CASE WHEN v = 0 THEN '' ELSE '_' || (['rotate', 'noise', 'elastic', 'optical', 'clahe', 'affine', 'perspective', 'brightness', 'blur', 'grid', 'hue', 'median'])[v] END || '.png' AS file FROM documents, (SELECT unnest(range(0, 13)) AS v)")
def thirteen_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.variants(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", splits.TRANSFORMS)


_LOT = "(('0x' || substr(md5(page_id || ':{}:3'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(f"""WITH p AS (SELECT p_partkey AS page_id, (300 + p_partkey % 200)::INT AS height FROM part), c AS (SELECT page_id, height, {_LOT.format("crop")} < 0.5 AS cut, floor(floor(height * 0.2::DOUBLE) / 2) + 1 AS most FROM p)
SELECT page_id, CASE WHEN cut THEN floor({_LOT.format("top")} * most) ELSE 0 END::INT AS y1, (height - CASE WHEN cut THEN floor({_LOT.format("bottom")} * most) ELSE 0 END)::INT AS y2 FROM c""")
def vertical_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (300 + F.col("p_partkey") % 200).cast("int").alias("height"))
    return splits.vertical_crops(pages, "page_id", "height", 3).select("page_id", "y1", "y2")
