"""Search, normal forms, similarity and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import records as R
from vellum.operators import redact, search
from vellum.sources.tables import LINES_SQL, lines, load

TERMS = ["the", "ung", "tion", "que"]
_TERMS_SQL = "x"
for _t in TERMS:
    _TERMS_SQL = f"regexp_replace({_TERMS_SQL}, '{_t}', '', 'gi')"
#: A copy of each document with a deterministic edit stands for what another extractor reads.
_EDIT, _EDIT_SQL = ("th|ei", "q"), "regexp_replace(text, 'th|ei', 'q', 'g')"


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _edited(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("other", F.regexp_replace("text", *_EDIT))


def search_substring(spark, sf_dir):
    return search.substring(_docs(spark, sf_dir), "tion")


def search_overlapping(spark, sf_dir):
    return search.overlapping(_docs(spark, sf_dir), "erer")


def search_whole_word(spark, sf_dir):
    return search.whole_word(_docs(spark, sf_dir), "the")


def search_regex(spark, sf_dir):
    return search.regex(_docs(spark, sf_dir), "th[a-z]{2,5}ing")


def search_word_bounds(spark, sf_dir):
    return search.word_bounds(_docs(spark, sf_dir), "ing the ")


def search_by_page(spark, sf_dir):
    return search.by_page(_docs(spark, sf_dir), "tion")


def search_annotations_union(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    notes = labels.select("doc_id", F.concat(F.lit("toxic "), F.col("toxic").cast("string"), F.lit(" quality "), F.col("quality").cast("string")).alias("note"))
    return search.with_annotations(_docs(spark, sf_dir), notes, "toxic 1")


def typographic_normalize(spark, sf_dir):
    out = T.typographic(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("size"), F.md5(out).alias("digest"))


def fold_ascii(spark, sf_dir):
    return _docs(spark, sf_dir).where(T.is_ascii(F.col("text"))).select("doc_id", F.md5(T.folded(F.col("text"))).alias("digest"))


def fold_unicode(spark, sf_dir):
    out = T.folded(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("size"), F.md5(out).alias("digest"))


def text_normalize(spark, sf_dir):
    out = T.alnum(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("size"), F.md5(out).alias("digest"))


def bigram_jaccard(spark, sf_dir):
    d = _edited(spark, sf_dir).select("doc_id", T.alnum(F.col("text")).alias("a"), T.alnum(F.col("other")).alias("b"))
    return d.select("doc_id", F.round(T.pair_similarity("a", "b"), 6).alias("similarity"))


def coverage_ratio(spark, sf_dir):
    return _edited(spark, sf_dir).select("doc_id", F.round(T.coverage(F.col("other"), F.col("text")), 6).alias("coverage"))


def _tiers(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("other", F.regexp_replace("text", *_EDIT))
    d = d.withColumn("a", T.alnum(F.col("text"))).withColumn("b", T.alnum(F.col("other")))
    d = d.select("doc_id", "source", "text", F.length("a").alias("size"), T.coverage(F.col("other"), F.col("text")).alias("cover"), T.pair_similarity("a", "b").alias("similarity"))
    d = d.withColumn("worse", F.least("cover", "similarity"))
    return d.select("doc_id", "source", T.tier(F.col("text"), F.col("size"), F.col("worse")).alias("tier"))


def confidence_tier(spark, sf_dir):
    return _tiers(spark, sf_dir)


def worst_tier(spark, sf_dir):
    d = _tiers(spark, sf_dir)
    return d.groupBy("source").agg(F.max_by("tier", T.tier_rank(F.col("tier"))).alias("worst"), F.count("*").alias("documents"))


def multiset_jaccard(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return redact.multiset_similarity(c.withColumn("side", F.col("role") == "user"), "conv_id", "side", "text", T.BLANKS)


def line_jaccard(spark, sf_dir):
    d = _edited(spark, sf_dir)
    both = lines(d).withColumn("side", F.lit(True)).unionByName(lines(d, text_col="other").withColumn("side", F.lit(False)))
    both = both.withColumn("line", F.regexp_replace("line", T.BLANKS, ""))
    return redact.multiset_similarity(both, "doc_id", "side", "line", None)


def seq_agreement_lcs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(later, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.sequence_agreement("text", "next"), 6).alias("agreement"))


def trim_punct_antijoin(spark, sf_dir):
    seen = load(spark, sf_dir, "benchmark").select("item_id", "text")
    return redact.unseen_words(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), seen.select("text"), ["conv_id", "turn"])


def dehyphenate(spark, sf_dir):
    out = T.dehyphenated(F.replace("text", F.lit("tion "), F.lit("tion-\n")))
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("size"), F.md5(out).alias("digest"))


def list_marker(spark, sf_dir):
    return lines(_docs(spark, sf_dir)).select("doc_id", "line_no", T.list_marker(F.col("line")).alias("marker")).where("marker <> ''")


def error_cluster(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    message = F.concat(F.col("event_type"), F.lit(" 12 failed for user "), F.col("user_id").cast("string"), F.lit(" with "), F.col("props"))
    return e.groupBy(T.collapsed_message(message).alias("message")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def redact_terms(spark, sf_dir):
    out = T.without_terms(F.col("text"), TERMS)
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("size"), F.md5(out).alias("digest"))


def redact_verify_remaining(spark, sf_dir):
    # a removal can bring a term together anew, so what is left of every term is counted, after one pass and after a second one
    once = T.without_terms(F.col("text"), TERMS)
    d = _docs(spark, sf_dir).select(once.alias("once")).withColumn("twice", T.without_terms(F.col("once"), TERMS))
    left = [F.sum(T.remaining(F.col(c), [t])).alias(f"{c}_{t}") for c in ("once", "twice") for t in TERMS]
    return d.agg(*left, F.count("*").alias("documents"))


def redact_carriers(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return redact.carriers(d.select("doc_id", F.col("source").alias("info"), F.col("lang").alias("title"), F.col("text").alias("note")), ["src1", "en", "the"])


def redact_counts(spark, sf_dir):
    return redact.counts(_docs(spark, sf_dir), TERMS)


def word_wrap(spark, sf_dir):
    w = load(spark, sf_dir, "benchmark").select("item_id", T.wrapped(F.col("text"), 30).alias("w"))
    return w.select("item_id", F.size("w").alias("lines"), F.md5(F.concat_ws("|", "w")).alias("digest"))


def suggested_names(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("files/part "), (F.col("s_suppkey") % 3).cast("string"), F.lit(".v2.pdf")).alias("path"))
    out = R.numbered_names(s.withColumn("path", R.suggested_name(F.col("path"), "REDACTED")), "path", "s_suppkey")
    return out.select("s_suppkey", "path", R.suggested_name(F.col("path"), F.concat(F.lit("pages_1-"), (F.col("s_suppkey") % 4).cast("string"))).alias("subset"))


def safe_copy_report(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    docs = d.select("doc_id", T.without_terms(F.col("text"), TERMS[:2]).alias("text"), (F.col("doc_id") % 5 == 0).cast("int").alias("skipped"),
        (F.col("doc_id") % 9).alias("info"), (F.col("doc_id") % 2 == 0).alias("xmp"), (F.col("doc_id") % 3).alias("attachments"))
    asked = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(" The"), F.lit("the"), F.lit("ab"), F.lit("tion"))).when(F.col("doc_id") % 4 == 1,
        F.array(F.lit("x"), F.lit(" "))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("ung")))
    hidden, images = d.where("doc_id % 7 = 0").select("doc_id", F.lit(2).alias("n")), d.where("doc_id % 6 = 0").select("doc_id", F.lit(1).alias("n"))
    return redact.safe_copy(docs, d.select("doc_id", F.explode(asked).alias("term")), hidden, images)


QUERIES = {f.__name__: f for f in (safe_copy_report, word_wrap, suggested_names, search_substring, search_overlapping, search_whole_word,
    search_regex, search_word_bounds, search_by_page, search_annotations_union, typographic_normalize, fold_ascii, fold_unicode, text_normalize,
        bigram_jaccard, coverage_ratio, confidence_tier, worst_tier, multiset_jaccard, line_jaccard, seq_agreement_lcs, trim_punct_antijoin,
            dehyphenate, list_marker, error_cluster, redact_terms, redact_verify_remaining, redact_carriers, redact_counts)}

_SUBSTRING = f"""WITH {LINES_SQL}, hits AS (SELECT doc_id, line_no, line, lower(line) AS low, instr(lower(line), 'tion') AS pos FROM lines WHERE contains(lower(line), 'tion')),
spans AS (SELECT *, greatest(1, pos - 30) AS a, least(length(line), pos - 1 + 4 + 30) AS b FROM hits)"""
_BIGRAMS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"
_TIER = f"""WITH n AS (SELECT doc_id, source, text, {_EDIT_SQL} AS other, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace({_EDIT_SQL}, '[^A-Za-z0-9]', '', 'g')) AS b FROM documents),
s AS (SELECT *, {_BIGRAMS.format('a')} AS x, {_BIGRAMS.format('b')} AS y FROM n),
j AS (SELECT *, len(list_intersect(x, y)) AS both_n FROM s),
m AS (SELECT *, CASE WHEN len(x) + len(y) - both_n = 0 THEN 1.0
ELSE both_n / (len(x) + len(y) - both_n) END AS sim, length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS lt, length(regexp_replace(other, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS lo FROM j),
c AS (SELECT *, CASE WHEN lt = 0 THEN 1.0 ELSE lo / lt END AS cov FROM m),
t AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 'Unverified' WHEN length(a) < 32 THEN 'Ok' WHEN least(cov, sim) < 0.5 THEN 'Severe'
WHEN least(cov, sim) < 0.9 THEN 'Degraded' ELSE 'Ok' END AS tier, sim, cov FROM c)"""
_MULTISET = """, k AS (SELECT id, side, w, count(*) AS n FROM tok GROUP BY ALL),
p AS (SELECT id, w, coalesce(max(n) FILTER (side), 0) AS a, coalesce(max(n) FILTER (NOT side), 0) AS b FROM k GROUP BY ALL)
SELECT id AS {0}, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS similarity FROM p GROUP BY id"""
_BARE = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_LEFT = ", ".join(f"CAST(sum(len(regexp_extract_all(lower({c}), '{t}'))) AS BIGINT) AS {c}_{t}" for c in ("once", "twice") for t in TERMS)
_CARRY = "trim(regexp_replace(regexp_replace(regexp_replace({0}, 'src1', '', 'gi'), 'en', '', 'gi'), 'the', '', 'gi'), ' ' || chr(9) || chr(10) || chr(13))"

ORACLES = {
    "safe_copy_report": f"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(text, 'the', '', 'gi'), 'ung', '', 'gi'), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'))) AS x FROM documents),
p AS (SELECT doc_id, x, CASE doc_id % 4 WHEN 0 THEN ['the', 'ab', 'tion'] WHEN 1 THEN ['x'] WHEN 2 THEN ['ung'] ELSE [] END AS terms FROM t),
c AS (SELECT *, list_filter(terms, lambda w: length(w) >= 3) AS ch FROM p), r AS (SELECT *, CAST(len(list_filter(ch, lambda w: contains(x, w))) AS INTEGER) AS lft FROM c),
s AS (SELECT doc_id, CAST(len(terms) AS INTEGER) AS previews, CAST(len(ch) AS INTEGER) AS checked, lft AS remaining, CAST(len(terms) - len(ch) AS INTEGER) AS short, CASE WHEN len(ch) = 0 THEN 'NotChecked' WHEN lft > 0 THEN 'Warning' ELSE 'Verified' END AS content,
CASE WHEN doc_id % 7 = 0 THEN 'Warning' ELSE 'Verified' END AS hidden_text, CASE WHEN len(terms) = 0 THEN 'NotChecked'
WHEN doc_id % 6 = 0 THEN 'Warning' ELSE 'Verified' END AS raster, doc_id % 9 AS info_scrubbed, doc_id % 2 = 0 AS had_xmp, doc_id % 3 AS attachments FROM r)
SELECT *, CAST((doc_id % 5 = 0)::INT + (content = 'Warning')::INT + (hidden_text = 'Warning')::INT + (raster = 'Warning')::INT AS INTEGER) AS warnings FROM s""",
    "word_wrap": """WITH RECURSIVE l AS (SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM benchmark),
w AS (SELECT item_id, ln, string_split(line, ' ') AS ws FROM l),
f(item_id, ln, ws, i, done, cur) AS (SELECT item_id, ln, ws, 1, CAST([] AS VARCHAR[]), '' FROM w UNION ALL
SELECT item_id, ln, ws, i + 1, CASE WHEN cur <> '' AND length(cur || ' ' || ws[i]) > 30 THEN list_append(done, cur) ELSE done END, CASE
WHEN cur = '' OR length(cur || ' ' || ws[i]) > 30 THEN ws[i] ELSE cur || ' ' || ws[i] END FROM f WHERE i <= len(ws)),
e AS (SELECT item_id, ln, CASE WHEN len(ws) = 1 AND ws[1] = '' THEN [''] WHEN cur = '' THEN done ELSE list_append(done, cur) END AS o FROM f WHERE i > len(ws)),
a AS (SELECT item_id, flatten(list(o ORDER BY ln)) AS o FROM e GROUP BY item_id) SELECT item_id, CAST(len(o) AS INTEGER) AS lines, md5(array_to_string(o, '|')) AS digest FROM a""",
    "suggested_names": """WITH s AS (SELECT s_suppkey, 'files/part ' || (s_suppkey % 3) || '.v2_REDACTED' AS stem, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier),
p AS (SELECT s_suppkey, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS stem FROM s)
SELECT s_suppkey, stem || '.pdf' AS path, stem || '_pages_1-' || (s_suppkey % 4) || '.pdf' AS subset FROM p""",
    "search_substring": _SUBSTRING + " "
        "SELECT doc_id, line_no, CAST((length(low) - length(replace(low, 'tion', ''))) // 4 AS INTEGER) AS matches, (CASE WHEN a > 1 THEN '...' "
            "ELSE '' END) || substr(line, a, b - a + 1) || (CASE WHEN b < length(line) THEN '...' ELSE '' END) AS context FROM spans",
    "search_overlapping": "SELECT * "
        "FROM (SELECT doc_id, CAST(len([i FOR i IN range(1, length(text) - 2) IF substr(text, i, 4) = 'erer']) AS INTEGER) AS matches FROM documents) WHERE matches > 0",
    "search_whole_word": r"SELECT * "
        r"FROM (SELECT doc_id, CAST(len([w FOR w IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') IF w = 'the']) AS INTEGER) AS words, CAST(len([w FOR w IN regexp_split_to_array(lower(text), '[ \t\n\r\f\v\x{a0}]+') IF w = 'the']) AS INTEGER) AS tokens FROM documents) WHERE words > 0",
    "search_regex": "SELECT * "
        "FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, 'th[a-z]{2,5}ing')) AS INTEGER) AS matches, regexp_extract(text, 'th[a-z]{2,5}ing') AS first FROM documents) WHERE matches > 0",
    "search_word_bounds": f"""WITH {LINES_SQL}, parts AS (SELECT doc_id, line_no, string_split(lower(line), 'ing the ') AS p FROM lines WHERE contains(lower(line), 'ing the ')),
m AS (SELECT doc_id, line_no, unnest([list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * 8 FOR i IN range(1, len(p))]) AS s FROM parts),
ws AS (SELECT doc_id, line_no, string_split(line, ' ') AS p FROM lines), we AS (SELECT doc_id, line_no, p, unnest(range(1, len(p) + 1)) AS i FROM ws),
w AS (SELECT doc_id, line_no, p[i] AS word, coalesce(list_sum([length(x) + 1 FOR x IN p[1:i - 1]]), 0) AS a FROM we WHERE p[i] <> '')
SELECT m.doc_id, m.line_no, CAST(m.s AS INTEGER) AS match_start, min_by(word, a) AS first_word, max_by(word, a) AS last_word, CAST(min(a) AS INTEGER) AS left_c, CAST(max(a + length(word)) AS INTEGER) AS right_c
FROM m JOIN w ON m.doc_id = w.doc_id AND m.line_no = w.line_no AND a < s + 8 AND a + length(word) > s GROUP BY ALL""",
    "search_by_page": _SUBSTRING + " "
        "SELECT doc_id, CAST(line_no // 50 AS INTEGER) AS page_no, CAST(sum((length(low) - length(replace(low, 'tion', ''))) // 4) AS BIGINT) AS matches, count(*) AS lines FROM hits GROUP BY ALL",
    "search_annotations_union": f"WITH {LINES_SQL} "
        f"SELECT doc_id, CAST(sum((length(line) - length(replace(lower(line), 'toxic 1', ''))) // 7) AS BIGINT) AS matches, 'text' AS origin "
            f"FROM lines WHERE contains(lower(line), 'toxic 1') GROUP BY ALL UNION ALL SELECT doc_id, 1, 'annotation' FROM labels WHERE toxic = 1",
    "typographic_normalize": r"SELECT doc_id, CAST(length(o) AS INTEGER) AS size, md5(o) AS digest "
        r"FROM (SELECT doc_id, trim(regexp_replace(translate(text, '’‘ʼ′–—−', '''''''''---'), '[ \t\n\r\f\v\x{a0}]+', ' ', 'g'), ' ') AS o FROM documents)",
    "fold_ascii": "SELECT doc_id, md5(text) AS digest FROM documents WHERE strlen(text) = length(text)",
    "text_normalize": "SELECT doc_id, CAST(length(o) AS INTEGER) AS size, md5(o) AS digest "
        "FROM (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS o FROM documents)",
    "bigram_jaccard": _TIER + " SELECT doc_id, round(sim, 6) AS similarity FROM t",
    "coverage_ratio": _TIER + " SELECT doc_id, round(cov, 6) AS coverage FROM t",
    "confidence_tier": _TIER + " SELECT doc_id, source, tier FROM t",
    "worst_tier": _TIER + " "
        "SELECT source, ['Ok', 'Unverified', 'Degraded', 'Severe'][max(list_position(['Ok', 'Unverified', 'Degraded', 'Severe'], tier))] AS worst, count(*) AS documents FROM t GROUP BY source",
    "multiset_jaccard": r"WITH tok AS (SELECT * "
        r"FROM (SELECT conv_id AS id, role = 'user' AS side, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v\x{a0}]+')) AS w FROM conversations) "
            r"WHERE w <> '')" + _MULTISET.format("conv_id"),
    "line_jaccard": f"WITH tok AS (SELECT id, side, regexp_replace(w, '[ \\t\\n\\r\\f\\v\\x{{a0}}]+', '', 'g') AS w "
        f"FROM (SELECT doc_id AS id, true AS side, unnest(string_split(text, chr(10))) AS w FROM documents UNION ALL "
            f"SELECT doc_id, false, unnest(string_split({_EDIT_SQL}, chr(10))) FROM documents) "
                f"WHERE regexp_replace(w, '[ \\t\\n\\r\\f\\v\\x{{a0}}]+', '', 'g') <> '')" + _MULTISET.format("doc_id"),
    "trim_punct_antijoin": r"""WITH t AS (SELECT conv_id, turn, lower(trim(unnest(regexp_split_to_array(text, '[ \t\n\r\f\v\x{a0}]+')), '.,:;!?"''()[]')) AS word FROM conversations),
v AS (SELECT DISTINCT lower(trim(unnest(regexp_split_to_array(text, '[ \t\n\r\f\v\x{a0}]+')), '.,:;!?"''()[]')) AS word FROM benchmark)
SELECT conv_id, turn, word, count(*) AS n FROM t WHERE word <> '' AND word NOT IN (SELECT word FROM v) GROUP BY ALL""",
    "dehyphenate": r"SELECT doc_id, CAST(length(o) AS INTEGER) AS size, md5(o) AS digest "
        r"FROM (SELECT doc_id, regexp_replace(replace(text, 'tion ', 'tion-' || chr(10)), '(\p{L})-\n(\p{Ll})', '\1\2', 'g') AS o FROM documents)",
    "list_marker": f"WITH {LINES_SQL} SELECT * "
        f"FROM (SELECT doc_id, line_no, regexp_extract(line, '^ *([•·‣◦*⁃∙\\-–—]|[0-9]{{1,3}}[.)]|\\p{{L}}[.)])(?: |$)', 1) AS marker FROM lines) WHERE marker <> ''",
    "error_cluster": "SELECT substr(regexp_replace(event_type || ' 12 failed for user ' || user_id || ' with ' || props, '[0-9]+', 'N', 'g'), 1, 66) AS message, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "redact_terms": f"SELECT doc_id, CAST(length(o) AS INTEGER) AS size, md5(o) AS digest "
        f"FROM (SELECT doc_id, trim({_TERMS_SQL}, ' ' || chr(9) || chr(10) || chr(13)) AS o FROM (SELECT doc_id, text AS x FROM documents))",
    "redact_verify_remaining": f"WITH o AS (SELECT {_BARE.format(_TERMS_SQL)} AS x FROM (SELECT text AS x FROM documents)), "
        f"t AS (SELECT x AS once, {_BARE.format(_TERMS_SQL)} AS twice FROM o) SELECT {_LEFT}, count(*) AS documents FROM t",
    "redact_carriers": f"SELECT doc_id, nullif({_CARRY.format('source')}, '') AS info, CASE WHEN {_CARRY.format('lang')} = '' THEN '[redacted]' "
        f"ELSE {_CARRY.format('lang')} END AS title, nullif({_CARRY.format('text')}, '') AS note FROM documents",
    "redact_counts": "SELECT term, CAST(sum(len(regexp_extract_all(lower(text), term))) AS BIGINT) AS matches, count_if(contains(lower(text), term)) AS documents FROM documents, (SELECT unnest(['the', 'ung', 'tion', 'que']) AS term) GROUP BY term",
}
