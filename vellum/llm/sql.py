"""SQL for the queries of this subpackage that SQL can express."""

from .license_scan import MENTIONS, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id AND 100 * q.n >= 80 * p.n AND 100 * p.n >= 80 * q.n
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON a = doc_id
"""

OP9 = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':42'), 1, 15) AS key FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w FROM sized GROUP BY source
), lv AS (
  SELECT *, 2 * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    sum(2 * source_size) OVER b - 2 * source_size AS before, sum(w) OVER () - sum(w) OVER b + w AS rest
  FROM src WINDOW b AS (ORDER BY 2 * source_size / w, source NULLS LAST)
), lv2 AS (SELECT *, (budget - before) / rest AS level FROM lv),
tg AS (
  SELECT source, source_size, budget, CASE WHEN level >= most / w THEN most::DOUBLE ELSE w * min_by(CASE WHEN level < most / w THEN level END, CASE WHEN level < most / w THEN most / w END) OVER () END AS target FROM lv2
), timed AS (
  SELECT s.*, source_size, target, budget, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS words
  FROM sized s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source
), entries AS (
  SELECT *, CASE WHEN target > 0 THEN (pass * source_size + words) / target ELSE 0 END AS finish FROM timed, (VALUES (0), (1)) AS p(pass)
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, pass, source NULLS LAST, key, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS took FROM entries
)
SELECT doc_id, size::BIGINT AS size, source_size, target, sum(CASE WHEN took THEN size ELSE 0 END)::BIGINT AS taken FROM cut
GROUP BY doc_id, source, key, size, source_size, target, words
"""


OP1 = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r(rule, verdict, h, p) AS (
  SELECT *, split_part(rule, '/', 1), substr(rule, instr(rule, '/')) FROM (VALUES
    ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')) AS t(rule, verdict)
), l(x) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org')),
best AS (
  SELECT page_id, host, path, max(struct_pack(n := length(rule), verdict := verdict, rule := rule)) AS b
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, b.rule AS rule,
  CASE WHEN b.rule IS NOT NULL THEN b.verdict WHEN EXISTS (SELECT 1 FROM l WHERE host = x OR ends_with(host, '.' || x)) THEN 'block' ELSE 'allow' END AS verdict
FROM best
"""

_ESCAPED = "regexp_replace(replace(text, '\\', '\\\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)|(\\[)(INST\\]|/INST\\]|ROLE\\]|/ROLE\\])', '\\1\\3\\\\\\2\\4', 'g')"

OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
  CAST(3 + sum(length({_ESCAPED}) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""



def _regex(template: str) -> str:
    """A template as a regular expression over words that each have a blank before them."""
    marks = {"<<optional>>": "(?:", "<</optional>>": ")?"}
    out = []
    for part in template.replace("<<", " <<").replace(">>", ">> ").split():
        if part.startswith("<<any:"):
            out.append("(?: [^ ]+){%s,%s}" % tuple(part[6:-2].split("-")))
        else:
            out.append(marks.get(part, " " + part))
    return "".join(out) + " "


def _labels_of(templates: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(s, '{_regex(t)}') THEN '{k}' END" for k, t in templates.items())


#: Every word is between two blanks of its own, so that phrases that follow each other are both found.
OP5 = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), s AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM w),
p AS (
  SELECT doc_id, i - 1 AS pos, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
    WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
), b AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS l FROM p WHERE label IS NOT NULL GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, list_filter([{_labels_of(TEMPLATES)}], lambda x: x IS NOT NULL) AS whole, list_filter([{_labels_of(MENTIONS)}], lambda x: x IS NOT NULL) AS named FROM s)
SELECT doc_id, n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(list_sort(l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(coalesce(l, []), whole), named))), ','), '') AS labels,
  CASE WHEN len(whole) > 0 THEN 1.0::DOUBLE WHEN len(named) > 0 THEN 0.8::DOUBLE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM m LEFT JOIN b USING (doc_id)
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.98
), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

ORACLES = {
    "op1_url_filters": OP1,
    "op2_chat_formatting": OP2,
    "op5_license_scans": OP5,
    "op7_embedding_near_dedup": OP7,
    "op8_minhash_near_dedup": OP8,
    "op9_source_mixing": OP9,
    "op10_warc": OP10,
}
