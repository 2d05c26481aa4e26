"""Registered queries over the test tables, each beside its SQL.

The tables have no résumés, so documents stand in for them, benchmark items for job
descriptions and for reference renditions, events for put, take and sign-in logs.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import scratch
from docsift.functions import report
from docsift.functions import text as T
from docsift.operators import archive, gate, lint, matching, parity, phrases, records, redirects, staging, tokens
from docsift.plans import api
from docsift.session import spread
from docsift.sources import addresses, inputs
from docsift.streaming.staging import ended, failures_per_span, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


# the SQL's own account of what the flags mean
_FLAGS = f"""
  SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l,
    trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS s,
    list_transform(string_split(lower(coalesce(text, '')), chr(10)),
      lambda x: trim(regexp_replace(regexp_replace(x, ':$', ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS lines
  FROM documents"""
_HAS = {k: f"list_has_any(lines, [{_in(v)}])" for k, v in lint.HEADINGS.items()}
_PREDICATES = f"""
  SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS n_words,
    regexp_matches(l, '{T.EMAIL}') AS has_email, regexp_matches(l, '{T.PHONE}') AS has_phone,
    regexp_matches(l, '{T.YEAR}') AS has_date, regexp_matches(l, '{T.RANGE}') AS has_range,
    {_HAS["experience"]} AND {_HAS["education"]} AND {_HAS["skills"]} AS has_sections,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[A-Z][A-Z &/]{{3,40}}$'))) > 0
      AND NOT ({" OR ".join(_HAS.values())}) AS odd_headings,
    regexp_matches(l, '{T.ODD_DATE.replace("'", "''")}') AS odd_dates
  FROM flags"""
_FINDINGS = f"""
  WITH flags AS ({_FLAGS}), p AS ({_PREDICATES})
  SELECT doc_id, 'no_email' AS id, 'high' AS severity FROM p WHERE NOT has_email
  UNION ALL SELECT doc_id, 'no_phone', 'medium' FROM p WHERE NOT has_phone
  UNION ALL SELECT doc_id, 'missing_sections', 'medium' FROM p WHERE NOT has_sections
  UNION ALL SELECT doc_id, 'no_dates', 'medium' FROM p WHERE NOT has_date AND n_words > 0
  UNION ALL SELECT doc_id, 'no_date_ranges', 'medium' FROM p WHERE NOT has_range AND n_words > 0
  UNION ALL SELECT doc_id, 'x_odd_headings', 'low' FROM p WHERE odd_headings
  UNION ALL SELECT doc_id, 'x_odd_dates', 'low' FROM p WHERE odd_dates"""


@query(f"WITH flags AS ({_FLAGS}), p AS ({_PREDICATES}) SELECT doc_id, n_words::BIGINT AS n_words, has_email, has_phone, has_date, has_range FROM p")
def q01_lint_flags(spark, sf_dir):
    return lint.prepared(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "has_email", "has_phone", "has_date", "has_range")


@query(_FINDINGS)
def q02_lint_findings(spark, sf_dir):
    return lint.findings(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "id", "severity")


@query(f"""
WITH f AS ({_FINDINGS}), g AS (
  SELECT doc_id, sum(CASE severity WHEN 'blocker' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 7 ELSE 3 END) AS lost,
    count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'high') AS high, count(*) AS n
  FROM f GROUP BY doc_id)
SELECT d.doc_id, greatest(0, 100 - coalesce(lost, 0))::INT AS score, coalesce(blockers, 0) AS blockers,
  coalesce(high, 0) AS high, coalesce(n, 0) AS n_findings FROM documents d LEFT JOIN g USING (doc_id)""")
def q03_score(spark, sf_dir):
    return lint.score_inline(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(left(coalesce(html, ''), 1024)), '^[ \t\n\x0b\f\r]+', '') AS head FROM pages)
SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
  head LIKE '<!doctype html%' OR head LIKE '<html%' OR contains(left(head, 512), '<head') OR contains(left(head, 512), '<meta') AS is_html,
  CASE WHEN contains(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1).regexp_extract('([^/]*)$', 1), '.')
    THEN regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1).regexp_extract('([^/]*)$', 1) ELSE 'document' END AS filename,
  CASE WHEN lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) <> 'https' THEN 'scheme'
    WHEN lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#:]*)', 1)) = '' THEN 'host' ELSE 'ok' END AS policy
FROM h""")
def q04_html_guard(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    content = F.col("html").cast("binary")
    pages = inputs.url_policy(pages, "url")
    why = F.col("url_error")
    policy = F.when(why.startswith("the scheme"), "scheme").when(why.contains("no host"), "host").when(why.isNotNull(), "address").otherwise("ok")
    return pages.select(
        "page_id", F.col("url_scheme").alias("scheme"), F.col("url_host").alias("host"), F.coalesce(inputs.looks_html(content), F.lit(False)).alias("is_html"),
        inputs.guess_filename(F.col("url"), "document").alias("filename"), policy.alias("policy"),
    )


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _jds(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("jd_id"), "text")


_ALIASES = f"(VALUES {_values(sorted(matching.ALIASES.items()))}) a(alias, name)"
_CANONICAL = "coalesce(a.name, CASE WHEN length(term) > 3 AND term NOT LIKE '%ss' THEN regexp_replace(term, 's$', '') ELSE term END)"


def _terms(text: str) -> str:
    """SQL for the list of a text's terms."""
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{T.NOT_TERM}'), lambda x: x <> '')"


def _key(terms: str) -> str:
    """SQL for a list of terms in the singular, joined."""
    return f"array_to_string(list_transform({terms}, lambda x: CASE WHEN length(x) > 3 AND x NOT LIKE '%ss' THEN regexp_replace(x, 's$', '') ELSE x END), ' ')"


def _phrases(spellings: str) -> str:
    """SQL for the phrases of spellings (alias, name); the aliases come first."""
    return f"""(SELECT phrase, len(string_split(phrase, ' ')) AS size, first(canonical ORDER BY rank, canonical) AS canonical FROM (
      SELECT {_key(_terms("alias"))} AS phrase, {_key(_terms("name"))} AS canonical, 0 AS rank FROM {spellings}
      UNION ALL SELECT {_key(_terms("name"))}, {_key(_terms("name"))}, 1 FROM {spellings}) WHERE contains(phrase, ' ') GROUP BY phrase)"""


def _runs(source: str, by: str) -> str:
    """SQL for the phrases ``ph`` in the lists ``w`` of a source."""
    return f"""SELECT {by}, i, size, canonical, array_to_string(w[i + 1 : i + size], ' ') AS term FROM (SELECT {by}, w, unnest(range(len(w))) AS i FROM {source})
      JOIN (SELECT DISTINCT size FROM ph) s ON i + size <= len(w) JOIN ph USING (size) WHERE {_key("w[i + 1 : i + size]")} = phrase"""


def _settled(hits: str, by: str) -> str:
    """SQL (recursive) for the phrases of ``hits`` that stand: from each, on to the next that starts behind it."""
    same = " AND ".join(f"h.{c} = s.{c}" for c in by.split(", "))
    first = "arg_min({'i': i, 'size': size, 'canonical': canonical, 'term': term}, (i, -size))"
    return f"""SELECT {by}, {first} AS x FROM {hits} GROUP BY {by}
      UNION ALL SELECT {", ".join(f"s.{c}" for c in by.split(", "))}, arg_min({{'i': h.i, 'size': h.size, 'canonical': h.canonical, 'term': h.term}}, (h.i, -h.size))
      FROM s JOIN {hits} h ON {same} AND h.i >= s.x.i + s.x.size GROUP BY {", ".join(f"s.{c}" for c in by.split(", "))}, s.x"""


def _jd_sql(spellings: str) -> str:
    """SQL for jt (jd_id, canonical), the terms of descriptions, and dt (doc_id, canonical), those of documents; WITH RECURSIVE."""
    filler = _in(sorted(set(matching.FILLER)))
    return f"""
  ph AS {_phrases(spellings)}, jl AS (SELECT item_id AS jd_id, string_split(text, chr(10)) AS lines, unnest(range(len(lines))) AS line_no FROM benchmark),
  jw AS (SELECT jd_id, line_no, {_terms("lines[line_no + 1]")} AS w FROM jl), jh AS ({_runs("jw", "jd_id, line_no")}),
  s AS ({_settled("jh", "jd_id, line_no")}), taken AS (SELECT jd_id, line_no, unnest(range(x.i, x.i + x.size)) AS i FROM s),
  jt AS (SELECT DISTINCT jd_id, {_CANONICAL} AS canonical FROM (SELECT jd_id, line_no, unnest(range(len(w))) AS i, w[i + 1] AS term FROM jw) x LEFT JOIN {spellings} ON a.alias = x.term
      WHERE length(term) > 1 AND NOT regexp_matches(term, '^[0-9+]+$') AND term NOT IN ({filler}) AND (jd_id, line_no, i) NOT IN (SELECT (jd_id, line_no, i) FROM taken)
    UNION SELECT jd_id, x.canonical FROM s),
  dw AS (SELECT doc_id, {_terms("text")} AS w FROM documents),
  dt AS (SELECT DISTINCT doc_id, {_CANONICAL} AS canonical FROM (SELECT doc_id, unnest(w) AS term FROM dw) x LEFT JOIN {spellings} ON a.alias = x.term
    UNION SELECT doc_id, canonical FROM ({_runs("dw", "doc_id")}))"""


_JD = _jd_sql(_ALIASES)


@query(f"""
WITH RECURSIVE {_JD}, n AS (SELECT jd_id, count(*) AS n_terms FROM jt GROUP BY jd_id),
  c AS (SELECT jd_id, doc_id, count(*) AS n_matched FROM jt JOIN dt USING (canonical) GROUP BY ALL)
SELECT jd_id, n_terms, max(round(n_matched / n_terms, 6)) AS best, count(*) FILTER (round(n_matched / n_terms, 6) >= 0.5) AS n_docs
FROM c JOIN n USING (jd_id) GROUP BY ALL""")
def q05_jd_coverage(spark, sf_dir):
    """Best coverage of each description by a document, and documents that cover half of it."""
    rows = matching.coverage(_documents(spark, sf_dir), _jds(spark, sf_dir))
    return rows.groupBy("jd_id", "n_terms").agg(F.max("coverage_required").alias("best"), F.count_if(F.col("coverage_required") >= 0.5).alias("n_docs"))


@query(f"WITH RECURSIVE {_JD} SELECT jd_id, canonical FROM jt WHERE canonical NOT IN (SELECT canonical FROM dt)")
def q06_jd_missing(spark, sf_dir):
    """Terms of descriptions that no document has."""
    wanted = scratch.written(matching.jd_terms(_jds(spark, sf_dir)), "jd-terms")
    docs = matching.doc_terms(_documents(spark, sf_dir), wanted).select("canonical").distinct()
    return wanted.select("jd_id", "canonical").join(docs, "canonical", "left_anti").select("jd_id", "canonical")


_SPACE = "[ \\t\\n\\x0b\\f\\r]+"
_SKILLS = ("skills", "technical skills", "key skills", "core competencies", "technology")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, 'Skills' || chr(10) || split_part(text, chr(10), 1) || chr(10) || 'EXPERIENCE' || substr(text, length(split_part(text, chr(10), 1)) + 1) AS t FROM d),
  n AS (SELECT doc_id, t, unnest(range(len(string_split(t, chr(10))))) AS n FROM w),
  l AS (SELECT doc_id, n, string_split(t, chr(10))[n + 1] AS line FROM n),
  h AS (SELECT *, CASE WHEN trim(regexp_replace(lower(regexp_replace(line, '[:#*]', ' ', 'g')), '{_SPACE}', ' ', 'g')) IN ({_in(_SKILLS)}) THEN 1
      WHEN regexp_matches(line, '^[A-Z][A-Z &/]{{3,40}}$') THEN 0 END AS h FROM l),
  s AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS skills FROM h),
  t AS (SELECT doc_id, skills, {_CANONICAL} AS canonical FROM (
      SELECT doc_id, skills, unnest(string_split_regex(lower(line), '{T.NOT_TERM}')) AS term FROM s WHERE h IS NULL) x
    LEFT JOIN {_ALIASES} ON a.alias = x.term WHERE term <> '' AND term NOT IN ({_in(sorted(set(matching.FILLER)))})),
  u AS (SELECT doc_id, canonical FROM t GROUP BY ALL HAVING min(skills) = 1)
SELECT doc_id, count(*) AS n_unsupported FROM u GROUP BY doc_id""")
def q07_unsupported_skill(spark, sf_dir):
    """Terms of the first line, set under a heading for skills, without a mention below it."""
    text = F.expr("concat('Skills\\n', substring_index(text, '\\n', 1), '\\nEXPERIENCE', substring(text, length(substring_index(text, '\\n', 1)) + 1))")
    docs = _documents(spark, sf_dir).fillna("", "text").select("doc_id", text.alias("text"))
    return matching.unsupported_counts(docs)


@query(f"""
WITH w AS (SELECT doc_id, {_terms("text")} AS w, ' ' || {_key("w")} || ' ' AS k FROM documents),
  t AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM w), n AS (SELECT alias, name, {_key(_terms("alias"))} AS ak, {_key(_terms("name"))} AS nk FROM {_ALIASES})
SELECT alias, name AS canonical, (SELECT count(*) FROM t WHERE term = alias) + (SELECT count(*) FROM w WHERE contains(alias, ' ') AND contains(k, ' ' || ak || ' ')) AS n_docs,
  (SELECT count(*) FROM w WHERE contains(k, ' ' || nk || ' ')) AS n_long FROM n""")
def q08_alias_match(spark, sf_dir):
    """Documents that use each other spelling of a term, and those that use its own, of one word or several."""
    docs = _documents(spark, sf_dir).select("doc_id", T.terms(F.col("text")).alias("terms"))
    known = matching.aliases(spark).select("alias", "canonical", phrases.key("alias").alias("ak"), phrases.key("canonical").alias("nk"))
    spelling = known.select(F.col("ak").alias("phrase"), F.col("ak").alias("canonical")).union(known.select("nk", "nk")).distinct().withColumn("n", F.size(F.split("phrase", " ")))
    runs = phrases.found(docs, spelling.filter("n > 1"), phrases.lengths(spelling.filter("n > 1")), ["doc_id"]).select("doc_id", F.col("canonical").alias("spelling"))
    words = docs.select("doc_id", F.explode(F.array_distinct("terms")).alias("word"))
    either = words.select("doc_id", F.explode(F.array(F.concat(F.lit("="), "word"), phrases.singular(F.col("word")))).alias("spelling"))  # as it stands, and in the singular
    asked = known.select(F.concat(F.lit("="), "alias").alias("spelling")).union(spelling.select("phrase")).distinct()
    counts = either.join(F.broadcast(asked), "spelling", "left_semi").unionByName(runs).distinct().groupBy("spelling").agg(F.count(F.lit(1)).alias("n_docs"))
    short = F.when(F.col("alias").contains(" "), F.col("ak")).otherwise(F.concat(F.lit("="), "alias"))  # one word counts as it stands
    rows = known.withColumn("short", short).join(counts.withColumnRenamed("spelling", "short"), "short", "left")
    rows = rows.join(counts.select(F.col("spelling").alias("nk"), F.col("n_docs").alias("n_long")), "nk", "left")
    return rows.select("alias", "canonical", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_long", F.lit(0)).alias("n_long"))


@query(f"""
WITH t AS (SELECT item_id, unnest(string_split_regex(lower(text), '{T.NOT_TERM}')) AS term FROM benchmark)
SELECT item_id, count(*) AS n_terms, count(*) FILTER (term NOT IN ({_in(sorted(set(matching.FILLER)))})) AS n_kept FROM t WHERE term <> '' GROUP BY item_id""")
def q09_filler_filter(spark, sf_dir):
    each = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))
    kept = matching.without_filler(each).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_terms")).join(kept, "item_id", "left").select("item_id", "n_terms", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


_BLOCKS = """
  lines AS (SELECT item_id, text, unnest(range(len(string_split(text, chr(10))))) AS block_no FROM benchmark),
  blocks AS (SELECT item_id, block_no, trim(regexp_replace(string_split(text, chr(10))[block_no + 1], '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS block FROM lines)"""


@query(f"""
WITH {_BLOCKS}, d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  n AS (SELECT trim(regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS line, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY 1)
SELECT item_id, block_no::INT AS block_no, coalesce(n_docs, 0) AS n_docs FROM blocks LEFT JOIN n ON line = block WHERE length(block) >= 20""")
def q10_block_parity_exact(spark, sf_dir):
    """Documents that have a block as a line of their own."""
    blocks = parity.blocks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text"))
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: T.squeezed(x)))).alias("text"))
    lines = lines.join(blocks.select("text").distinct(), "text", "left_semi")  # lines that are no block go before they are counted
    counts = lines.groupBy("text").agg(F.count(F.lit(1)).alias("n_docs"))
    return blocks.join(counts, "text", "left").select(F.col("key").alias("item_id"), "block_no", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _shingles(source: str, key: str, text: str) -> str:
    """SQL for rows (key, part): 3-term shingles, or the run of fewer terms."""
    return f"""SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1 : i + 3], ' ')) END) AS part
      FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce({text}, '')), '{T.NOT_TERM}'), lambda x: x <> '') AS w FROM {source})"""


@query(f"""
WITH {_BLOCKS}, long AS (SELECT * FROM blocks WHERE length(block) >= 20 AND len(list_filter(string_split_regex(lower(block), '{T.NOT_TERM}'), lambda x: x <> '')) >= 3),
  b AS ({_shingles("long", "item_id, block_no", "block")}), d AS (SELECT DISTINCT part FROM ({_shingles("documents", "doc_id", "text")}))
SELECT item_id, block_no::INT AS block_no, round(avg(CASE WHEN d.part IS NULL THEN 0 ELSE 1 END), 6) AS best_ratio,
  round(avg(CASE WHEN d.part IS NULL THEN 0 ELSE 1 END), 6) < {parity.MISSING} AS missing
FROM b LEFT JOIN d USING (part) GROUP BY ALL""")
def q11_block_parity_shingle(spark, sf_dir):
    """Blocks of benchmark items that the documents as a whole do not contain."""
    blocks = parity.blocks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")).withColumn("terms", T.terms(F.col("text")))
    each = blocks.filter(F.size("terms") >= parity.SHINGLE).select(F.col("key").alias("item_id"), "block_no", F.explode(parity.shingles(F.col("terms"))).alias("part"))
    # only shingles that a block has need to be found: the small side filters before anything is made distinct
    wanted = each.select("part").distinct()
    docs = _documents(spark, sf_dir).select(T.terms(F.col("text")).alias("terms"))
    there = docs.select(F.explode(parity.shingles(F.col("terms"))).alias("part")).join(wanted, "part", "left_semi").distinct()
    ratio = F.round(F.avg(F.coalesce("hit", F.lit(0))), 6)
    rows = each.join(there.withColumn("hit", F.lit(1)), "part", "left").groupBy("item_id", "block_no").agg(ratio.alias("best_ratio"))
    return rows.withColumn("missing", F.col("best_ratio") < parity.MISSING)


@query(f"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  k AS (SELECT conv_id * 1000000 + turn AS key, text, before FROM p WHERE before IS NOT NULL),
  a AS (SELECT key, term, count(*) AS n FROM (SELECT key, unnest(string_split_regex(lower(text), '{T.NOT_TERM}')) AS term FROM k) WHERE term <> '' GROUP BY ALL),
  b AS (SELECT key, term, count(*) AS n FROM (SELECT key, unnest(string_split_regex(lower(before), '{T.NOT_TERM}')) AS term FROM k) WHERE term <> '' GROUP BY ALL)
SELECT key, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 6) AS similarity
FROM a FULL JOIN b USING (key, term) GROUP BY key""")
def q12_text_similarity(spark, sf_dir):
    """Each turn of a conversation against the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).filter("before IS NOT NULL")
    keyed = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"), "text", "before")
    return parity.similarity(keyed.select("key", "text"), keyed.select("key", F.col("before").alias("text")))


@query("""
WITH i AS (SELECT l_suppkey, epoch(l_shipdate)::BIGINT // 86400 AS first, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS last FROM lineitem),
  m AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
  s AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m),
  g AS (SELECT l_suppkey, island, min(first) AS a, max(last) AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT l_suppkey, sum(n)::BIGINT AS n_intervals, sum(b - a)::BIGINT AS covered FROM g GROUP BY l_suppkey""")
def q13_interval_union(spark, sf_dir):
    """Days on which a supplier has something under way."""
    day = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("first"), (day + F.col("l_quantity").cast("long")).alias("last"))
    return matching.union_length(items, "l_suppkey")


@query(f"""
WITH t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '{T.NOT_TERM}')) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
  b AS (SELECT doc_id, sum(n)::BIGINT AS n_terms, max({{'n': n, 'term': term}}) AS top FROM t GROUP BY doc_id)
SELECT doc_id, top.term AS term, top.n AS n, n_terms, round(top.n / n_terms, 6) AS share FROM b
WHERE n_terms >= {lint.STUFFED_LEAST} AND round(top.n / n_terms, 6) > {lint.STUFFED}""")
def q14_stuffing(spark, sf_dir):
    return lint.stuffing(_documents(spark, sf_dir))


def _events(spark, sf_dir, *kinds: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.expr("unix_seconds(cast(ts AS timestamp))"))
    return events.filter(F.col("event_type").isin(*kinds)) if kinds else events


@query("""
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'click') WHERE place = 1""")
def q15_first_take(spark, sf_dir):
    return staging.first_takes(_events(spark, sf_dir, "click"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query("""
WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'error')
SELECT event_id, user_id, count(*) OVER w AS n_recent, count(*) OVER w >= 2 AS locked FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def q16_lockout_window(spark, sf_dir):
    """With a day instead of five minutes and two failures instead of eight, as events are sparse."""
    rows = staging.lockouts(_events(spark, sf_dir, "error"), "user_id", "at", 2, 86400)
    return rows.select("event_id", "user_id", "n_recent", "locked")


@query("""
WITH v AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS put_at FROM events WHERE event_type = 'view' GROUP BY user_id),
  c AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'click'),
  j AS (SELECT c.*, put_at IS NOT NULL AND sec >= put_at AND sec - put_at <= 604800 AS live FROM c LEFT JOIN v USING (user_id)),
  o AS (SELECT *, coalesce(max(live::INT) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS used FROM j)
SELECT event_id, user_id, sec, live AND NOT used AS ok FROM o""")
def q17_ttl_expiry(spark, sf_dir):
    """Clicks take what the user's last view has put, within a week and once."""
    puts = _events(spark, sf_dir, "view").groupBy(F.col("user_id").alias("id")).agg(F.max("at").alias("at"))
    taken = _events(spark, sf_dir, "click").select(F.col("event_id").alias("take_id"), F.col("user_id").alias("id"), "at")
    return staging.takes(puts, taken, 604_800).select(F.col("take_id").alias("event_id"), F.col("id").alias("user_id"), F.col("at").alias("sec"), "ok")


@query("""
WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec, length(props)::BIGINT AS bytes FROM events WHERE event_type = 'view')
SELECT event_id, user_id, count(*) OVER w AS n_live, (sum(bytes) OVER w)::BIGINT AS live_bytes FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)""")
def q18_live_entries(spark, sf_dir):
    """A store for each user, views as puts, a week to live."""
    puts = _events(spark, sf_dir, "view").select("event_id", F.col("user_id").alias("store"), "at", F.length("props").cast("long").alias("bytes"))
    return staging.live_entries(puts, "at", "bytes", 604_800).select("event_id", F.col("store").alias("user_id"), "n_live", "live_bytes")


@query("""
SELECT conv_id, turn, role, coalesce(lag(role) OVER w <> role, true) AS in_order, coalesce(length(text) <= lag(length(text)) OVER w, true) AS falling
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def q19_section_order(spark, sf_dir):
    """Speakers take turns, as sections follow their order; lengths fall, as dates do."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    in_order = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    falling = F.coalesce(F.length("text") <= F.lag(F.length("text")).over(order), F.lit(True))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", in_order.alias("in_order"), falling.alias("falling"))


_THREE = """
  c AS (SELECT d.doc_id, l.quality = 1 AS quality, l.toxic = 0 AS clean, d.n_chars >= 200 AS long FROM documents d LEFT JOIN labels l USING (doc_id)),
  u AS (SELECT doc_id, quality AS ok FROM c UNION ALL SELECT doc_id, clean FROM c UNION ALL SELECT doc_id, long FROM c),
  v AS (SELECT doc_id, count(*) FILTER (ok) AS n_pass, count(*) FILTER (NOT ok) AS n_fail, count(*) FILTER (ok IS NULL) AS n_skip FROM u GROUP BY doc_id)"""


def _three(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    made = [("label.quality", F.col("quality") == 1), ("label.clean", F.col("toxic") == 0), ("text.long", F.col("n_chars") >= 200)]
    return rows.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("id"), ok.alias("ok")) for i, ok in made])))


@query(f"""
WITH {_THREE} SELECT doc_id, n_pass, n_fail, n_skip,
  CASE WHEN n_pass + n_fail > 0 THEN floor((200 * n_pass + n_pass + n_fail) / (2 * (n_pass + n_fail)))::INT END AS score,
  n_fail = 0 AND n_pass > 0 AS passed, CASE WHEN n_pass + n_fail = 0 THEN 2 WHEN n_fail = 0 THEN 0 ELSE 1 END AS exit_code FROM v""")
def q20_three_valued_verdict(spark, sf_dir):
    """Three checks for each document; without a label, two of them skip."""
    return gate.verdict(_three(spark, sf_dir))


@query("""
SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(quality) AS n_labelled, grouping(lang, source)::BIGINT AS level
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def q21_corpus_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count("quality").alias("n_labelled"), F.grouping_id().alias("level"))


_SECTION = " ".join(f"WHEN key IN ({_in(v)}) THEN '{k}'" for k, v in matching.SECTIONS.items())


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, split_part(text, chr(10), 1) || chr(10) || '## Nice to have:' || substr(text, length(split_part(text, chr(10), 1)) + 1)
      || chr(10) || 'Benefits' || chr(10) || split_part(text, chr(10), 1) AS t FROM d),
  n AS (SELECT doc_id, t, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM w),
  l AS (SELECT doc_id, line_no, string_split(t, chr(10))[line_no + 1] AS line FROM n),
  k AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line, '[:#*-]', ' ', 'g'), '{_SPACE}', ' ', 'g'))) AS key FROM l),
  o AS (SELECT *, CASE {_SECTION} END AS opened FROM k),
  s AS (SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'required') AS section FROM o)
SELECT doc_id, line_no::INT AS line_no, md5(line) AS line_md5, section FROM s WHERE opened IS NULL AND trim(line, ' ') <> ''""")
def q22_header_split(spark, sf_dir):
    """Documents as descriptions: the first line is required, the rest nice to have, and the first again a benefit; whole texts, however long."""
    one = "substring_index(text, '\\n', 1)"
    text = F.expr(f"concat({one}, '\\n## Nice to have:', substring(text, length({one}) + 1), '\\nBenefits\\n', {one})")
    docs = _documents(spark, sf_dir).fillna("", "text").select(F.col("doc_id").alias("jd_id"), text.alias("text"))
    lines = matching.jd_lines(docs, most_chars=None)
    return lines.select(F.col("jd_id").alias("doc_id"), "line_no", F.md5("line").alias("line_md5"), "section")


_B64 = """
  s AS (SELECT doc_id, 'whole' AS kind, base64(encode(coalesce(text, ''))) AS b64 FROM documents
    UNION ALL SELECT doc_id, 'spaced', ' ' || base64(encode(coalesce(text, ''))) FROM documents UNION ALL SELECT doc_id, 'raw', text FROM documents)"""


@query(f"""
WITH {_B64}, v AS (SELECT *, regexp_matches(b64, '{inputs.BASE64}') AND length(b64) % 4 = 0 AS shape FROM s)
SELECT doc_id, kind, CASE WHEN coalesce(regexp_replace(b64, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'), '') = '' OR NOT shape THEN 'BadUpload' END AS error_class,
  CASE WHEN coalesce(regexp_replace(b64, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'), '') <> '' AND shape THEN octet_length(from_base64(CASE WHEN shape THEN b64 END)) END AS n_bytes FROM v""")
def q23_base64_guard(spark, sf_dir):
    """Texts in base64, with a blank before it, and not in base64 at all."""
    docs = _documents(spark, sf_dir)
    whole = F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    kinds = F.array(F.struct(F.lit("whole").alias("kind"), F.regexp_replace(whole, "[\\r\\n]", "").alias("b64")), F.struct(F.lit("spaced").alias("kind"), F.concat(F.lit(" "), F.regexp_replace(whole, "[\\r\\n]", "")).alias("b64")), F.struct(F.lit("raw").alias("kind"), F.col("text").alias("b64")))
    rows = inputs.decode_base64(docs.select("doc_id", F.inline(kinds)), "b64", "resume_base64")
    return rows.select("doc_id", "kind", "error_class", F.octet_length("content").cast("long").alias("n_bytes"))


_IP = "((event_id * 2654435761) % 4294967296)"
_OCTETS = " || '.' || ".join(f"(({_IP} // {256**i}) % 256)::VARCHAR" for i in (3, 2, 1, 0))
#: First groups of the addresses that are made; most lie in or beside a closed range.
_GROUPS = (0x2001, 0xFE80, 0xFC00, 0xFF02, 0x2A00, 0x64, 0x2002, 0x100, 0x3FFF, 0x3FF0, 0xFEC0, 0x1FFF)


def _narrowest(family: int, number: str) -> str:
    """SQL for whether a number is closed, the narrowest range first."""
    nets = sorted(((ipaddress.ip_network(x), closed) for xs, closed in ((addresses.CLOSED, True), (addresses.OPEN, False)) for x in xs), key=lambda n: -n[0].prefixlen)
    return "CASE " + " ".join(f"WHEN {number} BETWEEN {int(n[0])} AND {int(n[-1])} THEN {closed}" for n, closed in nets if n.version == family) + " ELSE false END"


@query(f"""
WITH e AS (SELECT event_id, {_IP} AS ip, {_OCTETS} AS host, list_extract({list(_GROUPS)}, event_id % {len(_GROUPS)} + 1) AS a, event_id // {len(_GROUPS)} % 48 AS b, 274 * (event_id // 576 % 2) AS c, event_id % 3 AS d FROM events),
  s AS (SELECT event_id, format('{{:x}}:{{:x}}:{{:x}}::{{:x}}', a, b, c, d) AS host, (a::UHUGEINT << 112) + (b::UHUGEINT << 96) + (c::UHUGEINT << 80) + d::UHUGEINT AS ip FROM e)
SELECT event_id, 4 AS family, host, {_narrowest(4, "ip")} AS closed FROM e UNION ALL SELECT event_id, 6, host, {_narrowest(6, "ip")} FROM s""")
def q24_address_policy(spark, sf_dir):
    """Addresses of both families made from event numbers against the closed ranges and the open ones within."""
    ip = F.expr("(event_id * 2654435761L) % 4294967296L")
    octet = lambda i: (F.floor(ip / 256**i) % 256).cast("string")
    group = lambda x: F.lower(F.hex(x.cast("long")))
    event, n = F.col("event_id"), len(_GROUPS)
    first = F.get(F.array(*map(F.lit, _GROUPS)), (event % n).cast("int"))
    six = F.concat(group(first), F.lit(":"), group(F.floor(event / n) % 48), F.lit(":"), group(F.floor(event / 576) % 2 * 274), F.lit("::"), group(event % 3))
    made = F.array(F.struct(F.lit(4).alias("family"), F.concat_ws(".", octet(3), octet(2), octet(1), octet(0)).alias("host")), F.struct(F.lit(6).alias("family"), six.alias("host")))
    rows = table(spark, sf_dir, "events").select("event_id", F.inline(made))
    authority = F.when(F.col("family") == 6, F.concat(F.lit("["), "host", F.lit("]"))).otherwise(F.col("host"))
    rows = rows.withColumn("url_host", inputs.host(F.concat(F.lit("https://u@"), authority, F.lit(":8443/x"))))
    shut = addresses.closed_hosts(rows, "url_host").withColumnsRenamed({"host": "url_host"}).withColumn("shut", F.lit(True))
    return rows.join(shut, "url_host", "left").select("event_id", "family", "host", F.coalesce("shut", F.lit(False)).alias("closed"))


@query("""
SELECT page_id, (CASE WHEN html IS NOT NULL AND html <> '' THEN 1 ELSE 0 END) + (CASE WHEN url LIKE 'https:%' THEN 1 ELSE 0 END) AS n_given,
  CASE WHEN (html IS NOT NULL AND html <> '') <> (url LIKE 'https:%') THEN (CASE WHEN url LIKE 'https:%' THEN 'url' ELSE 'base64' END) END AS source,
  CASE WHEN (html IS NOT NULL AND html <> '') = (url LIKE 'https:%') THEN 'BadUpload' END AS error_class FROM pages""")
def q25_source_resolution(spark, sf_dir):
    """Pages give their bytes, and their URL as well where it is https."""
    url = F.when(F.col("url").like("https:%"), F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("b"), url.alias("u"), F.lit(None).cast("string").alias("i"))
    out = inputs.resolve_source(rows, "resume", "b", "u", "i")
    n = (~inputs.blank(F.col("b"))).cast("int") + (~inputs.blank(F.col("u"))).cast("int")
    return out.select("page_id", n.alias("n_given"), "source", "error_class")


@query(f"""
WITH {_THREE}, w AS (SELECT *, n_fail = 0 AND n_pass > 0 AS passed, CASE WHEN n_pass + n_fail > 0 THEN floor((200 * n_pass + n_pass + n_fail) / (2 * (n_pass + n_fail)))::INT END AS score FROM v)
SELECT doc_id, '**' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' · ' || coalesce(score::VARCHAR, '-') || '/100** · ' || n_pass || ' passed, ' || n_fail || ' failed, ' || n_skip || ' skipped' AS line FROM w""")
def q26_verdict_line(spark, sf_dir):
    rows = gate.verdict(_three(spark, sf_dir))
    return rows.select("doc_id", report.verdict_line(*[F.col(c) for c in ("passed", "score", "n_pass", "n_fail", "n_skip")]).alias("line"))


@query(r"""
SELECT doc_id, 'text' AS format, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS words, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^' || chr(65279), '') AS text
FROM documents WHERE text <> ''""")
def q27_parse_documents(spark, sf_dir):
    """All documents as text files through the reader, page layout and text extraction."""
    files = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("content"))
    return api.extract(files).select("doc_id", "format", "words", "text")


@query("""
WITH f AS (SELECT user_id, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'error'),
  s AS (SELECT user_id, sec // 17280 - k AS slot FROM f, unnest(range(5)) u(k))
SELECT user_id, slot * 17280 AS starts, count(*) AS n FROM s GROUP BY ALL""")
def q28_sliding_failures(spark, sf_dir):
    """Failures in spans of a day, five of which start within each."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return failures_per_span(failed, 86_400).select(F.col("key").alias("user_id"), F.unix_seconds("window.start").alias("starts"), "n")


@query("""
WITH RECURSIVE a AS (
    SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec, event_type = 'click' AS ok, event_id % 4 = 0 AS expired,
      row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k
    FROM events WHERE event_type IN ('click', 'error')),
  s AS (
    SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS sec, ''::VARCHAR AS outcome, []::BIGINT[] AS failures FROM a
    UNION ALL
    SELECT user_id, k, event_id, sec, outcome, CASE outcome WHEN 'refused' THEN list_append(recent, sec) WHEN 'code' THEN [] ELSE recent END
    FROM (SELECT *, CASE WHEN len(recent) >= 2 THEN 'locked' WHEN expired THEN 'expired' WHEN NOT ok THEN 'refused' ELSE 'code' END AS outcome
      FROM (SELECT a.*, list_filter(s.failures, lambda x: x > a.sec - 1000000) AS recent FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)))
SELECT event_id, user_id, sec, outcome FROM s WHERE k > 0""")
def q29_sign_ins(spark, sf_dir):
    """Clicks as right and errors as wrong passphrases, each fourth of them late; two failures in 1,000,000 seconds lock."""
    attempts = _events(spark, sf_dir, "click", "error").select(
        "event_id", F.col("user_id").alias("key"), "at", (F.col("event_type") == "click").alias("ok"),
        (F.col("at") - F.when(F.col("event_id") % 4 == 0, F.lit(601)).otherwise(F.lit(600))).alias("pending_at"),
    )
    rows = staging.sign_ins(attempts, ("event_id",), least=2, seconds=1_000_000)
    return rows.select("event_id", F.col("key").alias("user_id"), F.col("at").alias("sec"), "outcome")


_PUTS = """
WITH RECURSIVE a AS (
    SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec, event_type, event_id % 47 AS bytes,
      row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), CASE event_type WHEN 'view' THEN 1 ELSE 0 END, event_id) AS k
    FROM events WHERE event_type IN ('view', 'click')),
  s AS (
    SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'click'::VARCHAR AS event_type, NULL::VARCHAR AS error,
      []::STRUCT(put_at BIGINT, n BIGINT, id BIGINT)[] AS held FROM a
    UNION ALL
    SELECT user_id, k, event_id, event_type, error, CASE WHEN event_type = 'click' THEN list_filter(live, lambda x: x.id <> event_id - 2)
      WHEN error IS NULL THEN list_append(live, {'put_at': sec, 'n': bytes, 'id': event_id}) ELSE live END
    FROM (SELECT *, CASE WHEN event_type = 'click' THEN NULL WHEN bytes = 0 THEN 'empty' WHEN bytes > 40 THEN 'too large' WHEN len(live) >= 3 THEN 'too many entries'
        WHEN coalesce(list_sum(list_transform(live, lambda x: x.n)), 0) + bytes > 60 THEN 'too many bytes' END AS error
      FROM (SELECT a.*, list_filter(s.held, lambda x: a.sec - x.put_at <= 2000000) AS live FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)))
SELECT event_id, user_id, error FROM s WHERE k > 0 AND event_type = 'view'"""


@query(_PUTS)
def q30_staging_puts(spark, sf_dir):
    """A store for each user: views are puts, a click takes the entry with the number before the last; small caps, as events are."""
    events = _events(spark, sf_dir, "view", "click").withColumn("store", F.col("user_id"))
    bytes_ = (F.col("event_id") % 47).cast("long")
    puts = events.filter("event_type = 'view'").select("event_id", "store", F.col("event_id").alias("id"), "at", bytes_.alias("bytes"))
    taken = events.filter("event_type = 'click'").select("store", (F.col("event_id") - 2).alias("id"), "at")
    rows = staging.put_errors(puts, order=("event_id",), taken=taken, ttl=2_000_000, max_bytes=40, max_entries=3, max_total=60)
    return rows.select("event_id", F.col("store").alias("user_id"), "error")


@query(f"""
WITH RECURSIVE {_JD}, o AS (SELECT item_id AS jd_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark),
  p AS (SELECT doc_id, jd_id FROM documents JOIN o ON doc_id % n = place),
  m AS (SELECT p.doc_id, p.jd_id, count(canonical) AS n_terms, count(dt.doc_id) AS n_matched FROM p LEFT JOIN jt USING (jd_id) LEFT JOIN dt USING (doc_id, canonical) GROUP BY ALL)
SELECT jd_id, doc_id, n_matched, n_terms - n_matched AS n_missing, coalesce(round(n_matched / nullif(n_terms, 0), 6), 0) AS coverage FROM m""")
def q31_review_pairs(spark, sf_dir):
    """Every document beside one description; all descriptions take part."""
    jds = _jds(spark, sf_dir)
    places = jds.select("jd_id", (F.row_number().over(Window.orderBy("jd_id")) - 1).cast("long").alias("place"))  # descriptions are few
    docs = _documents(spark, sf_dir)
    pairs = docs.select("doc_id", (F.col("doc_id") % F.lit(jds.count())).alias("place")).join(places, "place").select("jd_id", "doc_id")
    rows = api.jd_struct(docs, jds, pairs)
    return rows.select("jd_id", "doc_id", F.size("jd.matched").cast("long").alias("n_matched"), F.size("jd.missing").cast("long").alias("n_missing"), F.col("jd.coverage_required").alias("coverage"))


_OPENINGS = f"""(SELECT alias, min(name) AS name FROM (
      SELECT array_to_string(w[1:2], ' ') AS alias, 'two' || item_id % 5 AS name FROM (SELECT item_id, {_terms("text")} AS w FROM benchmark) WHERE len(w) > 2
      UNION ALL SELECT array_to_string(w[1:3], ' '), 'three' || item_id % 5 FROM (SELECT item_id, {_terms("text")} AS w FROM benchmark) WHERE len(w) > 2 AND item_id % 2 = 1
      UNION ALL SELECT array_to_string(w[2:3], ' '), 'later' || item_id % 5 FROM (SELECT item_id, {_terms("text")} AS w FROM benchmark) WHERE len(w) > 2
      UNION ALL SELECT * FROM {_ALIASES}) GROUP BY alias) a"""


def _openings(spark, sf_dir) -> DataFrame:
    """Other spellings made of the items' first terms, so that phrases overlap: 1-2, of every second item 1-3, and 2-3."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", T.terms(F.col("text")).alias("w")).filter(F.size("w") > 2)
    part = lambda a, n, name: F.struct(F.array_join(F.slice("w", a, n), " ").alias("alias"), F.concat(F.lit(name), (F.col("item_id") % 5).cast("string")).alias("canonical"))
    made = F.array(part(1, 2, "two"), F.when(F.col("item_id") % 2 == 1, part(1, 3, "three")), part(2, 2, "later"))
    return terms.select(F.inline(F.filter(made, lambda x: x.isNotNull()))).groupBy("alias").agg(F.min("canonical").alias("canonical"))


@query(f"""
WITH RECURSIVE {_jd_sql(_OPENINGS)}, n AS (SELECT jd_id, count(*) AS n_terms FROM jt GROUP BY jd_id),
  c AS (SELECT jd_id, doc_id, count(*) AS n_matched FROM jt JOIN dt USING (canonical) GROUP BY ALL)
SELECT jd_id, n_terms, max(n_matched) AS most, count(*) FILTER (round(n_matched / n_terms, 6) >= 0.5) AS n_docs
FROM c JOIN n USING (jd_id) GROUP BY ALL""")
def q36_phrase_coverage(spark, sf_dir):
    """As q05, with phrases of two and three terms that descriptions and documents have, in a table of other spellings."""
    rows = matching.coverage(_documents(spark, sf_dir), _jds(spark, sf_dir), _openings(spark, sf_dir))
    return rows.groupBy("jd_id", "n_terms").agg(F.max("n_matched").alias("most"), F.count_if(F.col("coverage_required") >= 0.5).alias("n_docs"))


@query(f"""
WITH RECURSIVE ph AS {_phrases(_OPENINGS)}, dw AS (SELECT doc_id, {_terms("text")} AS w FROM documents), h AS ({_runs("dw", "doc_id")}), s AS ({_settled("h", "doc_id")})
SELECT x.canonical AS canonical, count(*) AS n_places, count(DISTINCT doc_id) AS n_docs, sum(x.size)::BIGINT AS n_terms FROM s GROUP BY 1""")
def q37_phrase_places(spark, sf_dir):
    """Phrases as they stand in the documents, where of those that overlap the leftmost and longest counts."""
    known = scratch.written(phrases.dictionary(matching.aliases(spark, _openings(spark, sf_dir))), "phrases")
    docs = _documents(spark, sf_dir).select("doc_id", T.terms(F.col("text")).alias("terms"))
    rows = phrases.settled(phrases.found(docs, known, phrases.lengths(known), ["doc_id"]), ["doc_id"])
    return rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_places"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n").alias("n_terms"))


def _parts(words: str) -> str:
    """SQL for the distinct 3-term shingles of a list of terms, or the run of fewer."""
    return f"list_distinct(CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(greatest(len({words}) - 2, 1)), lambda i: array_to_string({words}[i + 1 : i + 3], ' ')) END)"


def _counterparts(n_lines: int) -> str:
    """SQL for the best counterpart of each benchmark block among all stretches of so many lines, every common shingle counted."""
    return f"""
WITH {_BLOCKS}, b AS (SELECT item_id, block_no, {_parts(_terms("block"))} AS parts FROM blocks WHERE length(block) >= {parity.LEAST}),
  dl AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
  dt AS (SELECT doc_id, no, {_terms("line")} AS w FROM dl), dn AS (SELECT doc_id, no, w, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM dt WHERE len(w) > 0),
  st AS ({" UNION ALL ".join(f"SELECT a.doc_id, a.no, {n} AS n, {' || '.join(['a.w', *[f'x{i}.w' for i in range(1, n)]])} AS w FROM dn a" + "".join(f" JOIN dn x{i} ON x{i}.doc_id = a.doc_id AND x{i}.k = a.k + {i}" for i in range(1, n)) for n in range(1, n_lines + 1))}),
  sl AS MATERIALIZED (SELECT doc_id, no, n, {_parts("w")} AS parts FROM st), sp AS (SELECT doc_id, no, n, len(parts) AS size, unnest(parts) AS part FROM sl),
  bp AS (SELECT item_id, block_no, len(parts) AS n_shingles, unnest(parts) AS part FROM b),
  c AS (SELECT item_id, block_no, n_shingles, doc_id, no, n, size, count(*) AS common FROM bp JOIN sp USING (part) GROUP BY ALL),
  best AS (SELECT item_id, block_no, arg_min({{'common': common, 'n': n, 'doc_id': doc_id, 'no': no}}, (-common, size, n, doc_id, no)) AS x FROM c WHERE common >= {parity.MISSING} * n_shingles - 1e-9 GROUP BY ALL)
SELECT item_id, b.block_no::INT AS block_no, len(parts)::INT AS n_shingles, round(x.common / len(parts), 6) AS ratio, x.doc_id AS doc_id, x.no::INT AS first, x.n::INT AS n_lines, x IS NULL AS missing
FROM b LEFT JOIN best USING (item_id, block_no)"""


def _best_blocks(spark, sf_dir, lines: int) -> DataFrame:
    blocks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    rows = parity.counterparts(blocks, spread(_documents(spark, sf_dir).withColumnRenamed("doc_id", "key"), "key"), lines=lines)
    return rows.withColumnsRenamed({"key": "item_id", "other": "doc_id"})


@query(_counterparts(1))
def q38_best_counterpart(spark, sf_dir):
    """The line of a document that has most of each benchmark line, if it has three fifths of it."""
    return _best_blocks(spark, sf_dir, 1)


@query(_counterparts(2))
def q39_best_counterpart_wrapped(spark, sf_dir):
    """As q38, where two consecutive lines of a document are a counterpart as well."""
    return _best_blocks(spark, sf_dir, 2)


#: Buckets of time in which events arrive, one after another, and seconds by which an event may come late.
_ARRIVALS, _LATE = 4, 500_000
#: Files of a part, all of which a batch of the stream reads.
_FILES = 8


@query(_PUTS)
def q41_staging_stream(spark, sf_dir):
    """q30 as a stream: events arrive in four parts and up to 500,000 seconds out of order; a tick at the end moves the clock past them."""
    events = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')")
    kind = F.when(F.col("event_type") == "view", "put").otherwise("take")
    ident = F.when(kind == "put", F.col("event_id")).otherwise(F.col("event_id") - 2).cast("string")
    rows = events.select(F.col("user_id").cast("string").alias("store"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), ident.alias("id"), (F.col("event_id") % 47).cast("long").alias("bytes"))
    first, last = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    if first is None:
        return spark.createDataFrame([], "event_id long, user_id long, error string")
    width = (last - first + _LATE) // _ARRIVALS + 1
    arrives = F.unix_seconds("ts") - first + F.pmod(F.xxhash64("event_id"), F.lit(_LATE))
    came = scratch.new_path(spark, "arrivals")
    for i in range(_ARRIVALS):
        # each part comes as so many files: a batch of the stream, however many files the events lie in
        rows.filter(F.floor(arrives / width) == i).repartition(_FILES).write.mode("append").parquet(came)
    tick = spark.createDataFrame([("", None, "tick", None, None)], "store string, event_id long, kind string, id string, bytes long")
    tick.select("store", "event_id", F.timestamp_seconds(F.lit(last + width + 2 * _LATE + 10)).alias("ts"), "kind", "id", "bytes").coalesce(1).write.mode("append").parquet(came)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(came)
    # what arrives together may be read in any order, hence the width of a part besides
    found = stored(stream, f"{width + _LATE} seconds", 2_000_000, 40, 3, 60)
    return ended(found, "puts").filter("kind = 'put'").select("event_id", F.col("store").cast("long").alias("user_id"), "error")


_SECURE = "CASE WHEN page_id % 10 = 9 THEN url ELSE regexp_replace(url, '^http:', 'https:') END"
_REFUSED = "(now NOT LIKE 'https:%' OR now LIKE 'https://10.0.0.%')"


@query(f"""
WITH RECURSIVE u AS (SELECT page_id, {_SECURE} AS url FROM pages),
  p AS (SELECT *, regexp_replace(url, '#.*$', '') AS asked, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u),
  f AS (SELECT p.*, n.url AS next, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder FROM p LEFT JOIN u n ON n.page_id = p.page_id + 8),
  l AS (SELECT *, CASE page_id % 8 WHEN 0 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 307 WHEN 5 THEN 308 WHEN 6 THEN 404 WHEN 7 THEN 303 ELSE 302 END AS status,
      CASE page_id % 8 WHEN 1 THEN '/moved/' || page_id WHEN 2 THEN next WHEN 3 THEN '../up/./' || page_id WHEN 4 THEN 'https://10.0.0.' || page_id % 256 || '/x' WHEN 5 THEN '#again' WHEN 7 THEN '//' || split_part(next, '//', 2) END AS location,
      CASE page_id % 8 WHEN 1 THEN root || '/moved/' || page_id WHEN 3 THEN root || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'up/' || page_id WHEN 5 THEN asked || '#again'
        WHEN 7 THEN split_part(url, '//', 1) || '//' || split_part(next, '//', 2) ELSE location END AS target FROM f),
  a AS (SELECT asked, status, location, target FROM (
      SELECT *, row_number() OVER (PARTITION BY asked ORDER BY status, location NULLS FIRST) AS k FROM (SELECT asked, status, location, target FROM l UNION ALL SELECT target, 200, NULL, NULL FROM l WHERE page_id % 8 = 1 OR page_id % 16 = 3)) WHERE k = 1),
  c AS (
    SELECT page_id, url, url AS now, regexp_replace(url, '#.*$', '') AS asked, 0 AS hops, []::VARCHAR[] AS trail FROM u
    UNION ALL
    SELECT page_id, url, target, regexp_replace(target, '#.*$', ''), hops + 1, list_append(trail, c.asked) FROM c JOIN a USING (asked)
    WHERE NOT {_REFUSED} AND status BETWEEN 301 AND 308 AND location IS NOT NULL AND NOT list_contains(list_append(trail, c.asked), regexp_replace(target, '#.*$', '')) AND hops < 3),
  e AS (SELECT page_id, arg_max({{'now': now, 'asked': asked, 'hops': hops, 'trail': trail}}, hops) AS x FROM c GROUP BY page_id),
  o AS (SELECT page_id, x.now AS now, x.hops AS hops, x.trail AS trail, asked, status, location, target FROM (SELECT page_id, x, x.asked AS asked FROM e) LEFT JOIN a USING (asked))
SELECT page_id, hops::INT AS hops, CASE WHEN {_REFUSED} THEN 'policy' WHEN status IS NULL THEN 'unreachable' WHEN status = 200 THEN 'ok' WHEN status = 404 THEN 'http' WHEN location IS NULL THEN 'no location'
    WHEN list_contains(list_append(trail, asked), regexp_replace(target, '#.*$', '')) THEN 'loop' ELSE 'too many redirects' END AS outcome,
  CASE WHEN NOT {_REFUSED} AND status = 200 THEN now END AS final_url, (len(trail) + CASE WHEN {_REFUSED} THEN 0 ELSE 1 END)::INT AS n_asked FROM o""")
def q42_redirect_chains(spark, sf_dir):
    """Every page asked for; answers lead on in eight ways, by the page's number, to pages, relative places, closed addresses and back."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 9, F.col("url")).otherwise(F.regexp_replace("url", "^http:", "https:")).alias("url"))
    after = pages.select((F.col("page_id") - 8).alias("page_id"), F.col("url").alias("next"))
    rows = pages.join(after, "page_id", "left").withColumn("kind", (F.col("page_id") % 8).cast("int"))
    number, kind = F.col("page_id").cast("string"), F.col("kind")
    status = F.get(F.array(*map(F.lit, (200, 302, 301, 307, 302, 308, 404, 303))), "kind")
    location = (
        F.when(kind == 1, F.concat(F.lit("/moved/"), number)).when(kind == 2, F.col("next")).when(kind == 3, F.concat(F.lit("../up/./"), number)).when(kind == 5, "#again")
        .when(kind == 4, F.concat(F.lit("https://10.0.0."), (F.col("page_id") % 256).cast("string"), F.lit("/x"))).when(kind == 7, F.regexp_extract("next", "(//.*)$", 1))
    )
    answers = rows.select("page_id", "kind", "url", status.alias("status"), location.alias("location"))
    there = answers.filter("kind = 1 OR page_id % 16 = 3").select(redirects.joined(F.col("url"), F.col("location")).alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"))
    found = redirects.follow(pages.withColumnRenamed("page_id", "id"), answers.select("url", "status", "location").unionByName(there))
    return found.select(F.col("id").alias("page_id"), "hops", "outcome", "final_url", F.size("trail").alias("n_asked"))


#: The second at which tokens are looked at, and how long they last: 20 days.
_NOW, _LASTS = 1_706_659_200, 1_728_000


@query(f"""
WITH RECURSIVE e AS (SELECT *, floor(epoch(ts))::BIGINT AS sec, CASE WHEN event_type IN ('signup', 'view') THEN event_id END AS token FROM events),
  p AS (SELECT *, last_value(token IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e),
  t AS (SELECT token, sec, CASE WHEN event_type = 'view' THEN held END AS parent FROM p WHERE token IS NOT NULL),
  u AS (SELECT held AS token, sec, event_id AS use_id FROM p WHERE held IS NOT NULL AND (event_type = 'view' OR event_type = 'click' AND event_id % 16 = 0)),
  f AS (SELECT token, token AS root, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.token, root, depth + 1 FROM t JOIN f ON t.parent = f.token),
  k AS (SELECT token, sec, row_number() OVER (PARTITION BY token ORDER BY sec, use_id) AS place FROM u),
  d AS (SELECT root, min(sec) AS undone_at FROM (SELECT token, sec FROM k WHERE place > 1 UNION ALL SELECT held, sec FROM p WHERE event_type = 'error' AND event_id % 64 = 0 AND held IS NOT NULL) JOIN f USING (token) GROUP BY root)
SELECT token, root, depth, CASE WHEN undone_at IS NOT NULL THEN 'revoked' WHEN token IN (SELECT token FROM k) THEN 'consumed' WHEN {_NOW} - sec > {_LASTS} THEN 'expired' ELSE 'live' END AS state, undone_at
FROM t JOIN f USING (token) LEFT JOIN d USING (root)""")
def q43_token_families(spark, sf_dir):
    """A signup starts a family, a view exchanges the user's last token; some clicks use a token besides, some errors revoke it."""
    events = _events(spark, sf_dir).withColumn("token", F.when(F.col("event_type").isin("signup", "view"), F.col("event_id")))
    before = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = scratch.written(events.withColumn("held", F.last("token", ignorenulls=True).over(before)).select("event_id", "event_type", "at", "token", "held"), "held")
    is_view, number = F.col("event_type") == "view", F.col("event_id")
    made = rows.filter("token IS NOT NULL").select("token", F.when(is_view, F.col("held")).alias("parent"), "at")
    uses = rows.filter(F.col("held").isNotNull() & (is_view | (F.col("event_type") == "click") & (number % 16 == 0))).select(F.col("held").alias("token"), "at", number.alias("use_id"))
    revoked = rows.filter("event_type = 'error' AND event_id % 64 = 0 AND held IS NOT NULL").select(F.col("held").alias("token"), "at")
    return tokens.liveness(made, uses, revoked, _NOW, _LASTS)


@query("""
WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec, CASE event_id % 9 WHEN 4 THEN left(props, length(props) - 1) WHEN 7 THEN replace(props, ': ', ': "x') WHEN 2 THEN '[1]' WHEN 5 THEN '{}' ELSE props END AS record FROM events),
  r AS (SELECT *, CASE WHEN json_valid(record) THEN try_cast(json_extract(record, '$.k') AS BIGINT) END AS k FROM e)
SELECT user_id, arg_max({'k': k, 'event_id': event_id}, (sec, event_id)) FILTER (k IS NOT NULL).k AS k, arg_max(event_id, (sec, event_id)) FILTER (k IS NOT NULL) AS event_id, count(*) FILTER (k IS NULL) AS n_corrupt
FROM r GROUP BY user_id HAVING max(sec) FILTER (k IS NOT NULL) >= 1706000000""".replace("arg_max({'k': k, 'event_id': event_id}, (sec, event_id)) FILTER (k IS NOT NULL).k AS k", "arg_max(k, (sec, event_id)) FILTER (k IS NOT NULL) AS k"))
def q44_client_store(spark, sf_dir):
    """Records of users in events' properties, four in nine of them broken on purpose: the newest good one of each, old ones swept, saved and loaded."""
    number = F.col("event_id") % 9
    broken = F.when(number == 4, F.expr("left(props, length(props) - 1)")).when(number == 7, F.replace("props", F.lit(": "), F.lit(': "x'))).when(number == 2, "[1]").when(number == 5, "{}").otherwise(F.col("props"))
    rows = _events(spark, sf_dir).select("event_id", "user_id", "at", broken.alias("json"))
    found = records.newest(records.parsed(rows, "json", "k long", ("k",)).drop("json"), "user_id", ["at", "event_id"])
    path = scratch.new_path(spark, "clients")
    records.save(found, path)
    records.save(records.load(spark, path).filter("at >= 1706000000"), path)
    return records.load(spark, path).select("user_id", "k", "event_id", "n_corrupt")


def _short_sql(rounds: int) -> str:
    """Each round: keys left, what they claim, and who gets it."""
    parts = ["p0 AS (SELECT event_id AS key FROM events)"]
    for i in range(rounds):
        held = " UNION ALL ".join(f"SELECT id FROM h{k}" for k in range(i)) or "SELECT NULL AS id WHERE false"
        parts.append(f"h{i} AS (SELECT min(key) AS key, id FROM (SELECT key, left(md5(key || ':{i}'), 5) AS id FROM p{i}) WHERE id NOT IN ({held}) GROUP BY id)")
        parts.append(f"p{i + 1} AS (SELECT key FROM p{i} WHERE key NOT IN (SELECT key FROM h{i}))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT key AS event_id, id, {i + 1} AS attempts FROM h{i}" for i in range(rounds))


@query(_short_sql(8))
def q45_short_ids(spark, sf_dir):
    """Ids of 20 bits for all events that get one in eight attempts; more events than ids cannot all have one."""
    return staging.short_ids(table(spark, sf_dir, "events"), "event_id", attempts=8)


_FOLDERS = """
  f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE (20200101 + doc_id % 28 + 100 * (doc_id % 12) + 10000 * (doc_id % 6))::VARCHAR || '_' END || source || '_' || lang || doc_id AS folder FROM documents),
  n AS (SELECT folder, unnest([CASE WHEN doc_id % 5 <> 1 THEN folder || '.docx' END, CASE WHEN doc_id % 5 <> 2 THEN folder || '.pdf' END, CASE WHEN doc_id % 3 <> 0 THEN folder || '_Design.pdf' END,
      CASE WHEN doc_id % 11 = 0 THEN 'notes.txt' END, '.hidden', CASE WHEN doc_id % 13 = 0 THEN lower(folder) || '.PDF' END]) AS filename FROM f),
  r AS (SELECT folder, filename, CASE WHEN filename = folder || '.docx' THEN 'docx' WHEN filename = folder || '.pdf' THEN 'pdf' WHEN filename = folder || '_Design.pdf' THEN 'design' END AS role FROM n WHERE filename IS NOT NULL)"""


def _folders(spark, sf_dir) -> DataFrame:
    """Files (folder, filename) of an archive with a folder for each document, some without a date or with files lacking or astray."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    date = F.when(n % 7 == 0, "").otherwise(F.concat((20_200_101 + n % 28 + 100 * (n % 12) + 10_000 * (n % 6)).cast("string"), F.lit("_")))
    rows = docs.select("doc_id", F.concat(date, "source", F.lit("_"), "lang", n.cast("string")).alias("folder"))
    own = lambda end: F.concat("folder", F.lit(end))
    names = F.array(
        F.when(n % 5 != 1, own(".docx")), F.when(n % 5 != 2, own(".pdf")), F.when(n % 3 != 0, own("_Design.pdf")),
        F.when(n % 11 == 0, "notes.txt"), F.lit(".hidden"), F.when(n % 13 == 0, F.concat(F.lower("folder"), F.lit(".PDF"))),
    )
    return rows.select("folder", F.explode(names).alias("filename")).filter("filename IS NOT NULL")


@query(rf"""
WITH {_FOLDERS}, g AS (SELECT folder, count(DISTINCT role) AS n_roles, count(*) FILTER (role IS NULL AND filename NOT LIKE '.%') AS n_stray FROM r GROUP BY folder)
SELECT folder, unnest(['archive.folder_name', 'archive.files', 'archive.extra_files']) AS id,
  unnest([regexp_matches(folder, '^[0-9]{{4}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])_[^_]+_.+$'), n_roles = 3, n_stray = 0]) AS ok FROM g""")
def q46_archive_checks(spark, sf_dir):
    """Name, files and strays of an archive folder for each document."""
    return archive.checks(archive.resolved(_folders(spark, sf_dir))).select("folder", "id", "ok")


@query(rf"""
WITH {_FOLDERS}, m AS (SELECT max((left(folder, 8), folder)) AS top FROM r WHERE regexp_matches(folder, '^[0-9]{{4}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])_[^_]+_.+$'))
SELECT folder, string_agg(filename, '|' ORDER BY filename) AS files FROM r WHERE folder = (SELECT top[2] FROM m) GROUP BY folder""".replace("max((left(folder, 8), folder)) AS top", "max({'date': left(folder, 8), 'folder': folder}) AS top").replace("top[2]", "top.folder"))
def q47_latest_archive(spark, sf_dir):
    """The newest dated folder and its files."""
    files = _folders(spark, sf_dir)
    found = files.join(F.broadcast(archive.latest(files)), "folder")  # one row
    return found.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("filename")), "|").alias("files"))
