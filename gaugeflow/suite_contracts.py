"""Contracts over the driver's tables and claims over what the other plans make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import quality
from .plans import changepoints, rolling
from .plans.compiled import Claim, Contract, evaluate, holds_sentence
from .sources.scratch import kept
from .suite import _DECIDED, _FLAGS, _ROLL, daily_levels, observations, query, table
from .suite_series import _IN_CONTEXT, _LAGS, _contexts, _fixed_detections, _lags, _rolling, _runs

_HEAD, _HREF = r"(?is)<h[1-6][^>]*>", r"(?is)<a\s[^>]*href\s*="

def contracts() -> list[Contract]:
    """What must hold of six tables."""
    return [
        Contract("documents", ("doc_id",), required=("doc_id", "text", "lang"), forbidden=("embedding",), not_blank=("source", "lang"), counts=("n_chars",), ids=("source",), safe=("text", "source"), min_rows=100,
                 checks={("known_language", "lang"): F.col("lang").isin("en", "de", "fr", "es"), ("length", "n_chars"): F.col("n_chars") == F.length("text")}),
        Contract("labels", ("doc_id",), required=("doc_id", "toxic", "stage"), fractions=("quality", "toxic"), references={"doc_id": ("documents", "doc_id")}),
        Contract("pages", ("page_id",), not_blank=("url",), urls=("url",), min_rows=10,
                 checks={("heading", "html"): F.col("html").rlike(_HEAD), ("link", "html"): F.col("html").rlike(_HREF), ("sentence", "html"): holds_sentence(F.col("html"), "All rights   reserved")}),
        Contract("benchmark", ("item_id",), not_blank=("text",), safe=("text",), min_rows=1000),
        Contract("conversations", ("conv_id", "turn"), not_blank=("role", "text"), counts=("turn",), checks={("known_role", "role"): F.col("role").isin("user", "assistant", "system")}),
        Contract("orders", ("o_orderkey",), counts=("o_orderkey",), references={"o_custkey": ("customer", "c_custkey")}, checks={("positive", "o_totalprice"): F.col("o_totalprice") > 0}),
    ]


_PATH = r"(?i)([a-z]:\\|/home/|/users/|file://)"
_CRED = r"(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*\S+"
_MISSING = "('', 'na', 'n/a', 'nan', 'null', 'none', 'tbd')"


def _sql_rules() -> str:
    blank = lambda c: f"coalesce(lower(trim(CAST({c} AS VARCHAR))) IN {_MISSING}, true)"
    key = lambda c: f"coalesce(trim(CAST({c} AS VARCHAR)) = '', true)"
    count = lambda c: f"NOT coalesce(regexp_full_match(trim(CAST({c} AS VARCHAR)), '\\+?\\d+'), false)"
    has = lambda c, p: f"coalesce(regexp_matches({c}, '{p}'), false)"
    rules = {
        "documents": [("blank_key", "doc_id", key("doc_id")), ("blank", "source", blank("source")), ("blank", "lang", blank("lang")), ("nonnegative_integer", "n_chars", count("n_chars")),
                      ("safe_id", "source", "NOT coalesce(NOT regexp_matches(source, '^([/\\\\]|[A-Za-z]:)') AND NOT list_contains(regexp_split_to_array(source, '[/\\\\]'), '..'), false)"),
                      ("local_path", "text", has("text", _PATH)), ("local_path", "source", has("source", _PATH)), ("credential", "text", has("text", _CRED)), ("credential", "source", has("source", _CRED)),
                      ("known_language", "lang", "NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)"), ("length", "n_chars", "NOT coalesce(n_chars = length(text), false)")],
        "labels": [("blank_key", "doc_id", key("doc_id")), ("fraction", "quality", "quality IS NOT NULL AND NOT quality BETWEEN 0 AND 1"), ("fraction", "toxic", "toxic IS NOT NULL AND NOT toxic BETWEEN 0 AND 1")],
        "pages": [("blank_key", "page_id", key("page_id")), ("blank", "url", blank("url")), ("https", "url", "NOT coalesce(regexp_matches(url, '^https://[^/\\s]+'), false)"),
                  ("heading", "html", f"NOT {has('html', _HEAD)}"), ("link", "html", f"NOT {has('html', _HREF)}"),
                  ("sentence", "html", "NOT coalesce(contains(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 'All rights reserved'), false)")],
        "benchmark": [("blank_key", "item_id", key("item_id")), ("blank", "text", blank("text")), ("local_path", "text", has("text", _PATH)), ("credential", "text", has("text", _CRED))],
        "conversations": [("blank_key", "conv_id", key("conv_id")), ("blank_key", "turn", key("turn")), ("blank", "role", blank("role")), ("blank", "text", blank("text")), ("nonnegative_integer", "turn", count("turn")),
                          ("known_role", "role", "NOT coalesce(role IN ('user', 'assistant', 'system'), false)")],
        "orders": [("blank_key", "o_orderkey", key("o_orderkey")), ("nonnegative_integer", "o_orderkey", count("o_orderkey")), ("positive", "o_totalprice", "NOT coalesce(o_totalprice > 0, false)")]}
    keys = {"documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "orders": ("o_orderkey",)}
    least = {"documents": 100, "pages": 10, "benchmark": 1000}
    out = [f"SELECT '{t}' AS \"table\", '{r}' AS name, '{c}' AS \"column\", count(*) FILTER ({v}) AS n FROM {t}" for t, rs in rules.items() for r, c, v in rs]
    out += [f"SELECT '{t}', 'min_rows', '*', CAST(greatest(0, {least.get(t, 1)} - count(*)) AS BIGINT) FROM {t}" for t in rules]
    out += [f"SELECT '{t}', 'duplicate_key', '{'+'.join(k)}', count(*) - count(DISTINCT ({', '.join(k)})) FROM {t}" if len(k) > 1 else f"SELECT '{t}', 'duplicate_key', '{k[0]}', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k[0]} FROM {t})) FROM {t}" for t, k in keys.items()]
    out += ["SELECT 'labels', 'reference', 'doc_id in documents.doc_id', count(*) FROM labels l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)",
            "SELECT 'orders', 'reference', 'o_custkey in customer.c_custkey', count(*) FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)",
            "SELECT 'labels', 'required_column', 'stage', 1"]
    return "SELECT *, n = 0 AS holds FROM (" + " UNION ALL ".join(out) + ")"


@query(_sql_rules())
def ct_compiled_rules(spark, sf_dir):
    """Contracts of six tables: keys, blanks, counts, fractions, ids, links, sentences, references, and columns."""
    tables = {t: table(spark, sf_dir, t) for t in ("documents", "labels", "pages", "benchmark", "conversations", "orders", "customer")}
    return evaluate(tables, contracts()).select("table", "name", "column", "n", "holds")


def _is(c: str, v: str):
    return F.count_if(F.col(c) == v)


def claims() -> list[Claim]:
    """Sentences over what the other plans make."""
    return [
        Claim("C01", "observations", "%d members hold %,d source rows.", (F.count_distinct("member"), F.count("*")), lambda a, b: (a > 0) & (b >= a)),
        Claim("C02", "observations", "%,d values are numbers, %,d blank, %,d malformed and %,d not finite.", (F.count("value"), F.count_if("flag_missing_value"), F.count_if("flag_malformed_value"), F.count_if("flag_nonfinite_value")), lambda a, b, c, d: (a > 0) & (b + c + d > 0)),
        Claim("C03", "observations", "%,d rows stand after a gap, %,d are out of order.", (F.count_if("flag_gap_before"), F.count_if("flag_out_of_order_timestamp")), lambda a, b: (a >= 0) & (b >= 0)),
        Claim("C04", "daily", "%d sensors have levels on %,d days.", (F.count_distinct("sensor"), F.count_distinct("day")), lambda a, b: (a == 5) & (b > 0)),
        Claim("C05", "daily", "The largest level is %.2f, on %s.", (F.max("value"), F.date_format(F.max_by("day", F.struct("value", "day")), "yyyy-MM-dd")), lambda a, b: (a > 0) & b.isNotNull()),
        Claim("C06", "attempts", "Of %,d attempts %,d are ok, %,d begin at an ineligible origin, %,d lack training and %,d a feature.",
              (F.count("*"), _is("status", "ok"), _is("status", "ineligible_core_origin"), _is("status", "insufficient_training"), _is("status", "feature_unavailable")), lambda n, a, b, c, d: n == a + b + c + d, "statistical inference"),
        Claim("C07", "attempts", "Later zero change is off by %.1f on average, the expanding median by %.1f.",
              tuple(F.avg(F.when((F.col("stage") == "evaluation") & (F.col("model") == m), F.col("absolute_error"))) for m in ("zero_change", "expanding_median")), lambda a, b: (a >= 0) & (b >= 0), "statistical inference"),
        Claim("C08", "decisions", "%d of %d decisions retain zero change; evaluation revises none.", (_is("retained", "zero_change"), F.count("*")), lambda a, b: a <= b, "statistical inference"),
        Claim("C09", "candidates", "%d candidates are stable over methods, %d within one, %d unstable.", tuple(_is("stability", v) for v in ("method_stable", "within_method_only", "unstable")), lambda a, b, c: a + b + c > 0, "statistical inference"),
        Claim("C10", "candidates", "%d candidates stand near metadata, %d near an event, %d near neither.", tuple(_is("classification", v) for v in ("metadata_aligned", "event_aligned", "unexplained")), lambda a, b, c: a + b + c > 0, "engineering interpretation"),
        Claim("C11", "peaks", "%d of %d lag configurations have a correlation; the largest in absolute value is at %d days.", (_is("status", "ok"), F.count("*"), F.max_by("peak_lag", F.struct(F.abs("peak_correlation"), -F.col("peak_lag")))), lambda a, b, c: (a <= b) & c.between(0, 30), "statistical inference"),
        Claim("C12", "peaks", "%d configurations have no series.", (_is("status", "no_series"),), lambda a: a >= 0),
        Claim("C13", "pages", "%,d of %,d pages have a heading.", (F.count_if(F.col("html").rlike(_HEAD)), F.count("*")), lambda a, b: a <= b),
    ]


# one text each of the plans' SQL, so that a claim's numbers come from the tables anew
_CLAIM_SQL = {
    "obs": f"""{_FLAGS} SELECT unnest([
 struct_pack(claim := 'C01', ok := count(*) > 0, said := format('{{}} members hold {{:,}} source rows.', count(DISTINCT member), count(*))),
 struct_pack(claim := 'C02', ok := count(value) > 0 AND count(*) FILTER (blank OR malformed OR bad) > 0, said := format('{{:,}} values are numbers, {{:,}} blank, {{:,}} malformed and {{:,}} not finite.', count(value), count(*) FILTER (blank), count(*) FILTER (malformed), count(*) FILTER (bad))),
 struct_pack(claim := 'C03', ok := true, said := format('{{:,}} rows stand after a gap, {{:,}} are out of order.', count(*) FILTER (gap), count(*) FILTER (d < 0)))]) AS x FROM flagged""",
    "roll": f"""{_ROLL} SELECT unnest([
 struct_pack(claim := 'C06', ok := count(*) = count(*) FILTER (status IN ('ok', 'ineligible_core_origin', 'insufficient_training', 'feature_unavailable')), said := format('Of {{:,}} attempts {{:,}} are ok, {{:,}} begin at an ineligible origin, {{:,}} lack training and {{:,}} a feature.', count(*), count(*) FILTER (status = 'ok'), count(*) FILTER (status = 'ineligible_core_origin'), count(*) FILTER (status = 'insufficient_training'), count(*) FILTER (status = 'feature_unavailable'))),
 struct_pack(claim := 'C07', ok := coalesce(avg(abs(error)) FILTER (stage = 'evaluation' AND model = 'zero_change') >= 0 AND avg(abs(error)) FILTER (stage = 'evaluation' AND model = 'expanding_median') >= 0, false), said := printf('Later zero change is off by %.1f on average, the expanding median by %.1f.', avg(abs(error)) FILTER (stage = 'evaluation' AND model = 'zero_change'), avg(abs(error)) FILTER (stage = 'evaluation' AND model = 'expanding_median')))]) AS x FROM att""",
    "decided": f"""{_DECIDED} SELECT struct_pack(claim := 'C08', ok := true, said := format('{{}} of {{}} decisions retain zero change; evaluation revises none.', count(*) FILTER (retained = 'zero_change'), count(*))) AS x FROM base""",
    "cand": f"""{_IN_CONTEXT} SELECT unnest([
 struct_pack(claim := 'C09', ok := count(*) > 0, said := format('{{}} candidates are stable over methods, {{}} within one, {{}} unstable.', count(*) FILTER (stability = 'method_stable'), count(*) FILTER (stability = 'within_method_only'), count(*) FILTER (stability = 'unstable'))),
 struct_pack(claim := 'C10', ok := count(*) > 0, said := format('{{}} candidates stand near metadata, {{}} near an event, {{}} near neither.', count(*) FILTER (classification = 'metadata_aligned'), count(*) FILTER (classification = 'event_aligned'), count(*) FILTER (classification = 'unexplained')))]) AS x FROM cand""",
    "lags": f"""{_LAGS}, top AS (SELECT DISTINCT ON (id) * FROM curve WHERE corr IS NOT NULL ORDER BY id, abs(corr) DESC, lag) SELECT unnest([
 struct_pack(claim := 'C11', ok := (SELECT count(*) FROM top) > 0, said := format('{{}} of {{}} lag configurations have a correlation; the largest in absolute value is at {{}} days.', (SELECT count(*) FROM top), (SELECT count(*) FROM cfg), (SELECT arg_max(lag, [abs(corr), -lag]) FROM top))),
 struct_pack(claim := 'C12', ok := true, said := format('{{}} configurations have no series.', (SELECT count(*) FROM cfg WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.id = cfg.id) AND (NOT EXISTS (SELECT 1 FROM x WHERE x.id = cfg.id) OR NOT EXISTS (SELECT 1 FROM y WHERE y.id = cfg.id)))))]) AS x""",
    "plain": f"""WITH d AS (SELECT o_orderpriority AS sensor, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)
 SELECT struct_pack(claim := 'C04', ok := count(DISTINCT sensor) = 5, said := format('{{}} sensors have levels on {{:,}} days.', count(DISTINCT sensor), count(DISTINCT day))) AS x FROM d
 UNION ALL SELECT struct_pack(claim := 'C05', ok := max(value) > 0, said := printf('The largest level is %.2f, on %s.', max(value), strftime(arg_max(day, (value, day)), '%Y-%m-%d'))) FROM d
 UNION ALL SELECT struct_pack(claim := 'C13', ok := true, said := format('{{:,}} of {{:,}} pages have a heading.', count(*) FILTER (regexp_matches(html, '{_HEAD}')), count(*))) FROM pages"""}


@query("SELECT x.claim AS claim, x.said AS statement, x.ok AS holds FROM (" + " UNION ALL ".join(f"SELECT x FROM ({q})" for q in _CLAIM_SQL.values()) + ")")
def sy_claim_matrix(spark, sf_dir):
    """Thirteen claims over seven tables, each table read once."""
    attempts, _ = _rolling(spark, sf_dir)
    runs = _runs(spark, sf_dir)
    tables = {
        "observations": quality.flagged(observations(spark, sf_dir)), "daily": daily_levels(spark, sf_dir), "attempts": attempts, "decisions": rolling.selection_decisions(attempts),
        "candidates": kept(changepoints.candidates_in_context(_fixed_detections(runs), runs, *_contexts(spark)), "candidates"), "peaks": _lags(spark, sf_dir)[1], "pages": table(spark, sf_dir, "pages")}
    return evaluate(tables, [], claims()).select(F.col("name").alias("claim"), "statement", "holds")
