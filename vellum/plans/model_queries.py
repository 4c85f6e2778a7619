"""Decoding, losses, attention, schedules, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as M
from ..functions import tokens as K
from ..operators import kernels, logs, splits
from .registry import query
from .standins import SQL_FRAMES, frames, read

_BEST = "list_transform(frames, lambda f: list_position(f, list_max(f)) - 1)"


@query(f"""SELECT id, array_to_string(list_filter(b, lambda x, i: x <> 7 AND (i = 1 OR x <> b[i - 1])), ' ') AS ids FROM (SELECT id, {_BEST} AS b FROM {SQL_FRAMES})""")
def ctc_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight steps over eight classes, the last of them blank."""
    return frames(spark, sf_dir).select("id", F.array_join(K.ctc_greedy(F.col("frames"), 7).cast("array<string>"), " ").alias("ids"))


@query(f"SELECT id, array_to_string({_BEST}, ' ') AS ids, array_to_string(CASE WHEN list_position({_BEST}, 3) > 0 THEN {_BEST}[1 : list_position({_BEST}, 3)::INT - 1] ELSE {_BEST} END, ' ') AS until_end FROM {SQL_FRAMES}")
def argmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.transform("frames", K.argmax)
    text = lambda a: F.array_join(a.cast("array<string>"), " ")
    return frames(spark, sf_dir).select("id", text(best).alias("ids"), text(K.until(best, 3)).alias("until_end"))


@query(f"""SELECT id, t::INT AS t, array_to_string(list_transform(list_sort(list_transform(range(8), lambda i: struct_pack(x := -f[i + 1], i := i)))[1:3], lambda s: s.i), ' ') AS best FROM (SELECT id, t, frames[t + 1] AS f FROM (SELECT *, unnest(range(8)) AS t FROM {SQL_FRAMES}))""")
def top_k_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("id", F.posexplode("frames").alias("t", "f"))
    return f.select("id", "t", F.array_join(K.top_k(F.col("f"), 3).cast("array<string>"), " ").alias("best"))


@query(f"""SELECT id, len(b)::INT AS n, array_to_string(list_concat(b, list_transform(range(max(len(b)) OVER (PARTITION BY id // 16) - len(b)), lambda i: -100)), ' ') AS padded
FROM (SELECT id, list_filter({_BEST}, lambda x: x <> 5) AS b FROM {SQL_FRAMES})""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences filled up to the longest of their batch of 16."""
    from pyspark.sql import Window

    own = frames(spark, sf_dir).select("id", K.without_ignored(F.transform("frames", lambda f: F.when(K.argmax(f) == 5, K.IGNORED).otherwise(K.argmax(f)))).alias("b"))
    longest = F.max(F.size("b")).over(Window.partitionBy(F.floor(F.col("id") / 16)))
    own = own.withColumn("m", longest)
    return own.select("id", F.size("b").alias("n"), F.array_join(K.padded(F.col("b"), F.col("m"), K.IGNORED).cast("array<string>"), " ").alias("padded"))


@query(f"""WITH g AS (SELECT id, {_BEST} AS b FROM {SQL_FRAMES}) SELECT id, len(list_distinct(list_transform(range(1, 8), lambda i: b[i : i + 1]))) < 7 AS repeats FROM g""")
def ngram_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("id", K.repeats_ngram(F.transform("frames", K.argmax), 2).alias("repeats"))


_LOGITS = f"(SELECT id, t::INT AS t, (label + t) % 8 AS y, frames[t + 1] AS z FROM (SELECT *, unnest(range(8)) AS t FROM {SQL_FRAMES} WHERE label IS NOT NULL))"
_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))))"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).where("label is not null").select("id", "label", F.posexplode("frames").alias("t", "z"))
    return own.select("id", "t", ((F.col("label") + F.col("t")) % 8).alias("y"), "z")


@query(f"SELECT id, t, i::INT AS i, round(exp(z[i + 1] / 0.5 - l), 9) AS p FROM (SELECT id, t, z, (list_max(z) / 0.5 + ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / 0.5))))) AS l, unnest(range(8)) AS i FROM {_LOGITS})")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With temperature 0.5."""
    p = M.softmax(M.scaled(F.col("z"), 0.5))
    return _logits(spark, sf_dir).select("id", "t", F.posexplode(p).alias("i", "p")).select("id", "t", "i", F.round("p", 9).alias("p"))


@query(f"""WITH c AS (SELECT id, t, {_LSE} - z[y + 1] AS ce, {_LSE} AS lse, list_sum(z) AS s, z, y FROM {_LOGITS})
SELECT id, t, round(ce, 9) AS ce, round(pow(1 - exp(-ce), 2) * ce, 9) AS focal, round(0.9 * ce - 0.1 / 7 * (s - 8 * lse + ce), 9) AS smoothed, round(list_max(list_filter(z, lambda x, i: i <> y + 1)), 9) AS wrong,
  round(greatest(0, 0.1 - (z[y + 1] - lse) + (list_max(list_filter(z, lambda x, i: i <> y + 1)) - lse)), 9) AS rank_loss, round(ce / pow(8::DOUBLE, 2), 9) AS by_length FROM c""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = F.col("z"), F.col("y")
    ce, wrong = M.cross_entropy(z, y), M.highest_wrong(z, y)
    rank = M.rank_margin(-ce, wrong - M.log_sum_exp(z))
    out = {"ce": ce, "focal": M.focal(z, y), "smoothed": M.smoothed(z, y), "wrong": wrong, "rank_loss": rank, "by_length": M.length_normalised(M.kl_one_hot(z, y), F.size(z), 2.0)}
    return _logits(spark, sf_dir).select("id", "t", *[F.round(c, 9).alias(k) for k, c in out.items()])


@query(f"SELECT id, b::INT AS b, d::INT AS d, round(list_sum(list_transform(frames[b * 8 // 5 + 1 : (b * 8 + 12) // 5], lambda f: f[d + 1])) / ((b * 8 + 12) // 5 - b * 8 // 5), 9) AS v FROM (SELECT *, unnest(range(8)) AS d FROM (SELECT *, unnest(range(5)) AS b FROM {SQL_FRAMES}))")
def frame_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames to five means, overlapping at the borders."""
    own = frames(spark, sf_dir).select("id", F.posexplode(M.pooled(F.col("frames"), 5)).alias("b", "f"))
    return own.select("id", "b", F.posexplode("f").alias("d", "v")).select("id", "b", "d", F.round("v", 9).alias("v"))


@query(f"SELECT id, i::INT AS i, j::INT AS j, round(list_cosine_similarity(frames[i + 1], frames[j + 1]), 9) AS c FROM (SELECT *, unnest(range(i)) AS j FROM (SELECT *, unnest(range(8)) AS i FROM {SQL_FRAMES}))")
def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the eight frames of each."""
    i = frames(spark, sf_dir).select("id", "frames", F.posexplode("frames").alias("i", "a"))
    j = i.select("id", "i", "a", F.posexplode("frames").alias("j", "b")).where("j < i")
    return j.select("id", "i", "j", F.round(M.cosine(F.col("a"), F.col("b")), 9).alias("c"))


@query(f"""WITH a AS (SELECT id, list_transform(frames, lambda f: list_dot_product(f, frames[1])) AS e, frames FROM {SQL_FRAMES}),
w AS (SELECT id, frames, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM a)
SELECT id, d::INT AS d, round(list_sum(list_transform(range(1, 9), lambda t: frames[t][d + 1] * w[t])) / list_sum(w), 9) AS v FROM (SELECT *, unnest(range(8)) AS d FROM w)""")
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.attention(F.get("frames", F.lit(0)), F.col("frames"))
    return frames(spark, sf_dir).select("id", F.posexplode(a).alias("d", "v")).select("id", "d", F.round("v", 9).alias("v"))


@query(f"""WITH s AS (SELECT id, i, list_transform(range(4), lambda j: list_cosine_similarity(frames[i + 1], frames[j + 5]) / 0.2) AS s, list_transform(range(4), lambda j: list_cosine_similarity(frames[i + 5], frames[j + 1]) / 0.2) AS r
  FROM (SELECT *, unnest(range(4)) AS i FROM {SQL_FRAMES})),
n AS (SELECT id, avg(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[i + 1]) AS a, avg(ln(list_sum(list_transform(r, lambda x: exp(x)))) - r[i + 1]) AS b FROM s GROUP BY id)
SELECT id, round(a, 9) AS nce, round(b, 9) AS back, round(a + b, 9) AS both FROM n""")
def nce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 0 to 3 against 4 to 7, their own partner among them, with temperature 0.2; the other way; and both."""
    a, b = F.slice("frames", 1, 4), F.slice("frames", 5, 4)
    own = frames(spark, sf_dir).select("id", M.contrast(a, b).alias("nce"), M.contrast(b, a).alias("back"))
    return own.select("id", F.round("nce", 9).alias("nce"), F.round("back", 9).alias("back"), F.round(F.col("nce") + F.col("back"), 9).alias("both"))


#: A small table of token embeddings, eight tokens of eight numbers, made by a rule.
_TABLE = [[((v * 8 + d) * 7 % 5 - 2) / 4 for d in range(8)] for v in range(8)]


@query(f"""WITH l AS (SELECT id, t, label, y, z, {_LSE} AS lse FROM (SELECT id, t::INT AS t, label, greatest(0, least(label + t - 2, 7))::INT AS y, frames[t + 1] AS z FROM (SELECT *, unnest(range(8)) AS t FROM {SQL_FRAMES} WHERE label IS NOT NULL))),
p AS (SELECT id, t, y, ((id + 3 * t) % 8)::INT AS w, z, lse, list_transform(z, lambda x: exp(x - lse)) AS p, list_transform(range(8), lambda v: list_transform(range(8), lambda d: (((v * 8 + d) * 7 % 5) - 2) / 4)) AS e FROM l),
x AS (SELECT *, list_transform(range(8), lambda d: list_sum(list_transform(range(8), lambda v: p[v + 1] * e[v + 1][d + 1]))) AS x FROM p),
s AS (SELECT *, list_transform(range(8), lambda v: (list_sum(list_transform(range(8), lambda d: e[v + 1][d + 1] * x[d + 1])) + p[1]) / 2) AS s FROM x),
m AS (SELECT id, greatest(0, 0.1 - (z[y + 1] - lse) + (z[w + 1] - lse)) AS rank, greatest(0, 0.1 * (s[y + 1] - s[w + 1]) - (z[y + 1] - lse) + (z[w + 1] - lse)) AS margin, lse - z[y + 1] AS ce, s FROM s)
SELECT id, round(avg(rank), 9) AS rank, round(avg(margin), 9) AS margin, round(sum(ce), 9) AS kl, round(avg(pow(1 - exp(-ce), 2) * ce), 9) AS focal, round(avg(rank) + avg(margin) + 0.01 * (sum(ce) + avg(pow(1 - exp(-ce), 2) * ce)), 9) AS total, round(avg(list_sum(s)), 9) AS similarity FROM m GROUP BY id""")
def calibration_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight steps: ranking, margin by token similarity, divergence, focal loss and their sum; labels are clamped to the classes."""
    own = frames(spark, sf_dir).where("label is not null").select("id", "label", F.posexplode("frames").alias("t", "z"))
    own = own.select("id", M.clamped_label((F.col("label") + F.col("t") - 2).cast("int"), F.size("z")).alias("y"), ((F.col("id") + 3 * F.col("t")) % 8).cast("int").alias("w"), "z", M.softmax(F.col("z")).alias("p"))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _TABLE])
    own = own.select("id", "y", "w", "z", M.log_softmax(F.col("z")).alias("lp"), M.token_similarity(F.col("p"), table).alias("s"))
    at = lambda i: F.get("lp", F.col(i))
    own = own.select("id", M.rank_margin(at("y"), at("w")).alias("rank"), M.similarity_margin(F.col("lp"), F.col("s"), F.col("y"), F.col("w")).alias("margin"), M.kl_one_hot(F.col("z"), F.col("y")).alias("ce"), M.focal(F.col("z"), F.col("y")).alias("focal"), M.total(F.col("s")).alias("s"))
    out = own.groupBy("id").agg(*[f(c).alias(c) for f, c in ((F.avg, "rank"), (F.avg, "margin"), (F.sum, "ce"), (F.avg, "focal"), (F.avg, "s"))])
    total = M.combined_loss(F.col("rank"), F.col("margin"), F.col("ce"), F.col("focal"))
    return out.select("id", *[F.round(c, 9).alias(n) for n, c in (("rank", "rank"), ("margin", "margin"), ("kl", "ce"), ("focal", "focal"), ("similarity", "s"))], F.round(total, 9).alias("total"))


_U = "(('0x' || substr(md5(trial || ':{}:11'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(f"""SELECT trial, round(exp(ln(0.000001::DOUBLE) + {_U.format("lr")} * (ln(0.0001::DOUBLE) - ln(0.000001::DOUBLE))), 15) AS lr, round({_U.format("wd")} * 0.1::DOUBLE, 12) AS weight_decay, floor({_U.format("warmup")} * 1001)::BIGINT AS warmup FROM (SELECT unnest(range(20)) AS trial)""")
def trial_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sets of hyper-parameters: so many are what is asked for."""
    t = splits.trials(spark, 20, 11)
    return t.select("trial", F.round("lr", 15).alias("lr"), F.round("weight_decay", 12).alias("weight_decay"), "warmup")


@query("""SELECT step, round(0.01 * pow(0.1, step // 30), 12) AS stepped, round(0.01 * CASE WHEN step < 10 THEN step / 10 ELSE greatest(0, (100 - step) / 90) END, 12) AS linear,
  round(0.01 * CASE WHEN step < 10 THEN step / 10 ELSE greatest(0, 0.5 * (1 + cos(pi() * (step - 10) / 90))) END, 12) AS cosine,
  round(0.01 * 0.5 * (1 + cos(pi() * (step - 10 * (pow(2, k) - 1)) / (10 * pow(2, k)))), 12) AS restarts
FROM (SELECT step, floor(log2(step / 10 + 1) + 1e-12) AS k FROM (SELECT unnest(range(101)) AS step))""")
def lr_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("id")
    rates = {"stepped": M.step_decay(s, 0.01, 30), "linear": M.linear_warmup(s, 0.01, 10, 100), "cosine": M.cosine_warmup(s, 0.01, 10, 100), "restarts": M.cosine_restarts(s, 0.01, 10)}
    return spark.range(101).select(s.alias("step"), *[F.round(c, 12).alias(k) for k, c in rates.items()])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("event_type").alias("metric"), "value")


@query("""WITH RECURSIVE l AS (SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
f AS (SELECT run, step, value AS best, 0 AS since FROM l WHERE step = 1 UNION ALL
  SELECT l.run, l.step, least(best, value), CASE WHEN value < best THEN 0 ELSE since + 1 END FROM f JOIN l ON l.run = f.run AND l.step = f.step + 1 WHERE since < 3)
SELECT run, max(step)::INT AS stop, min(best) AS best FROM f GROUP BY run""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.early_stop(_log(spark, sf_dir), "run", ["ts", "event_id"], "value", 3)


@query("""WITH RECURSIVE l AS (SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
f AS (SELECT run, 0::BIGINT AS step, 'inf'::DOUBLE AS best, 0 AS bad, 0.01::DOUBLE AS lr FROM l WHERE step = 1 UNION ALL
  SELECT l.run, l.step, least(best, value), CASE WHEN value < best OR bad + 1 > 3 THEN 0 ELSE bad + 1 END, CASE WHEN NOT value < best AND bad + 1 > 3 THEN lr * 0.5 ELSE lr END FROM f JOIN l ON l.run = f.run AND l.step = f.step + 1)
SELECT run, arg_max(lr, step) AS lr FROM f GROUP BY run""")
def reduce_on_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.on_plateau(_log(spark, sf_dir), "run", ["ts", "event_id"], "value", 0.01)


@query("SELECT event_type AS metric, min(value) AS value, arg_min(event_id, struct_pack(v := value, e := event_id)) AS event_id FROM events GROUP BY event_type")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.best_trial(_log(spark, sf_dir), "value", ["event_id"], ["metric"])


_METRICS = ("click", "view", "purchase", "signup", "error")


@query("SELECT user_id AS run, " + ", ".join(f"round(sum(value) FILTER (event_type = '{m}'), 6) AS {m}" for m in _METRICS) + " FROM events GROUP BY user_id")
def log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.pivoted(_log(spark, sf_dir), ["run"], "metric", "value", list(_METRICS))


@query("SELECT event_type AS metric, day(ts)::INT AS epoch, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def epoch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.epoch_means(_log(spark, sf_dir).withColumn("epoch", F.dayofmonth("ts")), ["metric", "epoch"], "value")


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def every_hundredth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of every hundredth batch: sampling is what it does."""
    return read(spark, sf_dir, "events").where("event_id % 100 = 0").select("event_id", "value")


@query()
def ctc_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform("frames", M.log_softmax)
    s = frames(spark, sf_dir).where("label is not null").select("id", steps.alias("steps"), F.array((F.col("label") % 7).cast("int"), ((F.col("label") + 1) % 7).cast("int")).alias("label"))
    return kernels.ctc_costs(s, "id", 7).select("id", F.round("cost", 9).alias("cost"))
