"""Queries of the data-set and evaluation operators over whole tables, with their DuckDB equivalents, whose tables and expected values are spelled out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import attribution, dataset, evaluation
from glyphmill.plans import eval_cases, lint
from glyphmill.plans.text_queries import arithmetic_key, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# training pairs with metadata of all kinds

_TYPES = ("correction", "detection", "cross_language", "explanation")


def records(spark, sf_dir) -> DataFrame:
    """A record for each user's turn, with every kind of metadata and of fault."""
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    k = F.col("conv_id") * 10 + F.col("turn")
    one_of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    kind = F.when(k % 13 == 0, F.lit(None)).otherwise(one_of(_TYPES, k))
    cross = k % 4 == 2
    m = F.struct(kind.alias("type"), F.when(~cross & (k % 7 != 0), F.concat(F.lit("rule_"), k % 5)).alias("rule"), F.when(~cross & (k % 11 != 0), one_of(("en-US", "fr-FR", "de-DE"), k)).alias("language"), F.lit(None).cast("string").alias("register"), F.when(cross & (k % 3 != 0), F.lit("en-US")).alias("source_language"), F.when(cross, F.lit("pt-PT")).alias("target_language"))
    text = F.when(k % 9 == 0, F.concat("text", F.lit("\\u00e9"))).otherwise(F.col("text"))
    out = F.when(k % 5 == 0, text).when(k % 17 == 0, F.lit(" ")).otherwise(F.concat(text, F.lit("!")))
    return t.select(k.alias("lineno"), F.when(k % 8 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Task "), k % 3)).alias("instruction"), text.alias("input"), out.alias("output"), F.when(k % 19 != 0, m).alias("metadata"))


_R = """WITH t AS (SELECT *, conv_id * 10 + turn AS k FROM conversations WHERE role = 'user'),
r AS (SELECT k AS lineno, CASE WHEN k % 8 = 0 THEN '  ' ELSE 'Task ' || k % 3 END AS instruction, CASE WHEN k % 9 = 0 THEN text || '\\u00e9' ELSE text END AS input,
  CASE WHEN k % 5 = 0 THEN input WHEN k % 17 = 0 THEN ' ' ELSE input || '!' END AS output, k % 19 <> 0 AS meta,
  CASE WHEN k % 13 <> 0 THEN ['correction', 'detection', 'cross_language', 'explanation'][k % 4 + 1] END AS type, CASE WHEN k % 4 <> 2 AND k % 7 <> 0 THEN 'rule_' || k % 5 END AS rule,
  CASE WHEN k % 4 <> 2 AND k % 11 <> 0 THEN ['en-US', 'fr-FR', 'de-DE'][k % 3 + 1] END AS language, CASE WHEN k % 4 = 2 AND k % 3 <> 0 THEN 'en-US' END AS source_language, CASE WHEN k % 4 = 2 THEN 'pt-PT' END AS target_language FROM t)"""


@query(
    _R
    + """ SELECT lineno, unnest(list_filter([CASE WHEN trim(instruction) = '' THEN 'empty_instruction' END, CASE WHEN trim(output) = '' THEN 'empty_output' END,
CASE WHEN contains(input, '\\u00e9') THEN 'escaped_input' END, CASE WHEN contains(output, '\\u00e9') THEN 'escaped_output' END, CASE WHEN NOT meta THEN 'no_metadata' END, CASE WHEN meta AND type IS NULL THEN 'no_type' END,
CASE WHEN meta AND type = 'cross_language' AND (source_language IS NULL OR target_language IS NULL) THEN 'no_language_pair' END, CASE WHEN meta AND type <> 'cross_language' AND (language IS NULL OR rule IS NULL) THEN 'no_language_or_rule' END,
CASE WHEN meta AND type = 'correction' AND input = output AND input <> '' THEN 'no_signal' END], lambda v: v IS NOT NULL)) AS issue FROM r"""
)
def metadata_issues(spark, sf_dir):
    """Faults of records, those of their metadata and doubly escaped characters too."""
    return dataset.issues(records(spark, sf_dir))


@query(
    _R
    + """, m AS (SELECT * FROM r), e AS (SELECT 'type' AS dimension, CASE WHEN meta THEN type END AS value FROM m
UNION ALL SELECT 'language', CASE WHEN meta THEN coalesce(language, target_language, 'multi') ELSE 'multi' END FROM m UNION ALL SELECT 'rule', CASE WHEN meta THEN coalesce(rule, 'cross_language') ELSE 'cross_language' END FROM m)
SELECT dimension, value, count(*)::BIGINT AS n FROM e GROUP BY ALL"""
)
def metadata_counts(spark, sf_dir):
    return dataset.counts(records(spark, sf_dir))


@query(_R + " SELECT l AS language, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN type = 'cross_language' THEN [source_language, target_language] ELSE [language] END) AS l FROM r WHERE meta) WHERE l IS NOT NULL GROUP BY l")
def metadata_languages(spark, sf_dir):
    return dataset.languages(records(spark, sf_dir))


@query(_R + " SELECT lineno, instruction, input, output FROM r WHERE NOT meta OR type IS NULL OR type IN ('correction', 'cross_language')")
def trainable_records(spark, sf_dir):
    return dataset.trainable(records(spark, sf_dir))


@query(
    _R
    + """, f AS (SELECT (trim(instruction) = '')::INT + (trim(output) = '')::INT + contains(input, '\\u00e9')::INT + contains(output, '\\u00e9')::INT + (NOT meta)::INT + coalesce((meta AND type IS NULL)::INT, 0)
  + coalesce((meta AND type = 'cross_language' AND (source_language IS NULL OR target_language IS NULL))::INT, 0) + coalesce((meta AND type <> 'cross_language' AND (language IS NULL OR rule IS NULL))::INT, 0)
  + coalesce((meta AND type = 'correction' AND input = output AND input <> '')::INT, 0) AS n, instruction, row_number() OVER (PARTITION BY instruction, input, output ORDER BY lineno) AS nth FROM r)
SELECT count(*)::BIGINT AS records, sum(n)::BIGINT AS issues, sum((nth > 1)::INT)::BIGINT AS repeats, count(DISTINCT instruction)::BIGINT AS instructions, sum(n) = 0 AND sum((nth > 1)::INT) = 0 AND count(DISTINCT instruction) > 1 AS clean FROM f"""
)
def dataset_verdict(spark, sf_dir):
    return dataset.verdict(records(spark, sf_dir))


@query(_R + " SELECT lineno, CASE WHEN meta AND type = 'cross_language' THEN coalesce(target_language, '_universal') WHEN meta THEN coalesce(language, '_universal') ELSE '_universal' END AS lang, CASE WHEN meta AND type = 'cross_language' THEN 'cross_language' WHEN meta THEN coalesce(rule, 'unknown') ELSE 'unknown' END AS rule FROM r")
def shown_pairs(spark, sf_dir):
    """Language and rule under which a page shows each pair."""
    return dataset.shown_order(records(spark, sf_dir)).select("lineno", "lang", "rule")


_HEAD = "'Below is an instruction that describes a task'"


@query(
    _R
    + f""" SELECT lineno, CASE WHEN input = '' THEN {_HEAD} || '. Write a response that appropriately completes the request.' || n || n || '### Instruction:' || n || instruction || n || n || '### Response:' || n
ELSE {_HEAD} || ', paired with an input that provides further context. Write a response that appropriately completes the request.' || n || n || '### Instruction:' || n || instruction || n || n || '### Input:' || n || input || n || n || '### Response:' || n END AS prompt FROM r, (SELECT chr(10) AS n)"""
)
def prompts(spark, sf_dir):
    return records(spark, sf_dir).select("lineno", evaluation.alpaca(F.col("instruction"), F.col("input")).alias("prompt"))


# pairs from templates


def _templates(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    lang = F.when(F.col("doc_id") % 11 == 0, "_universal").otherwise(lint.languages(F.col("lang")))
    return d.select(F.concat(F.lit("rule_"), F.col("doc_id") % 5).alias("rule"), lang.alias("lang"), F.col("doc_id").alias("idx"), F.concat("text", F.lit("...")).alias("raw"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("..."))).otherwise(F.concat("text", F.lit("…"))).alias("correct"))


_T = """WITH d AS (SELECT doc_id AS idx, 'rule_' || doc_id % 5 AS rule, CASE WHEN doc_id % 11 = 0 THEN '_universal' WHEN lang = 'en' THEN 'en-US' WHEN lang = 'fr' THEN 'fr-FR' WHEN lang = 'de' THEN 'de-DE' WHEN lang = 'es' THEN 'es-ES' END AS lang,
  text || '...' AS raw, CASE WHEN doc_id % 3 = 0 THEN text || '...' ELSE text || '…' END AS correct FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, CASE lang WHEN 'en-US' THEN 'American English' WHEN 'fr-FR' THEN 'French' WHEN 'de-DE' THEN 'German' WHEN 'es-ES' THEN 'European Spanish' END AS name FROM d)"""


@query(
    _T
    + """ SELECT idx, 'Identify typographic errors in this ' || coalesce(name, 'the given') || ' text.' AS instruction, raw AS input,
'Error: ' || CASE rule WHEN 'rule_0' THEN 'Three dots in ' || coalesce(name, 'the given') || ' text' WHEN 'rule_1' THEN 'Dots' ELSE 'Typographic error detected.' END || chr(10) || 'Corrected: ' || correct AS output FROM n WHERE raw <> correct"""
)
def pairs_detection(spark, sf_dir):
    errors = spark.createDataFrame([("rule_0", "Three dots in {lang} text"), ("rule_1", "Dots")], "rule string, description string")
    t = _templates(spark, sf_dir)
    made = dataset.detection_pairs(t.withColumn("rule", F.struct("rule", "idx")), errors.join(t.select("rule", "idx"), "rule").select(F.struct("rule", "idx").alias("rule"), "description"))
    return made.select(F.col("metadata.rule.idx").alias("idx"), "instruction", "input", "output")


@query(
    """WITH d AS (SELECT doc_id AS set_id, text FROM documents WHERE text IS NOT NULL), l(lang, name, mark) AS (VALUES ('en-US', 'American English', '.'), ('fr-FR', 'French', ' !'), ('nl-BE', 'Flemish Dutch', '?'))
SELECT set_id, a.lang AS source_language, b.lang AS target_language, 'Apply ' || b.name || ' typography conventions to this text, which was originally typeset for ' || a.name || '. Output only the corrected text, no explanation.' AS instruction, text || a.mark AS input, text || b.mark || b.mark AS output
FROM d, l a, l b WHERE a.lang <> b.lang"""
)
def pairs_cross_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    langs = F.explode(F.array(*[F.struct(F.lit(a).alias("lang"), F.lit(b).alias("mark")) for a, b in (("en-US", "."), ("fr-FR", " !"), ("nl-BE", "?"))]))
    each = d.select(F.col("doc_id").alias("set_id"), "text", langs.alias("l"))
    parallel = each.select("set_id", F.col("l.lang").alias("lang"), F.concat("text", "l.mark").alias("raw"), F.concat("text", "l.mark", "l.mark").alias("correct"))
    made = dataset.cross_language_pairs(parallel.withColumn("raw", F.struct("set_id", "raw")))
    return made.select(F.col("input.set_id").alias("set_id"), "metadata.source_language", "metadata.target_language", "instruction", F.col("input.raw").alias("input"), "output")


@query(
    _T
    + """ SELECT idx, 'Explain why this typographic correction is needed in ' || coalesce(name, lang) || '.' AS instruction, 'Original: ' || raw || chr(10) || 'Corrected: ' || correct AS input, 'Because ' || rule AS output
FROM (SELECT *, row_number() OVER (PARTITION BY rule, lang ORDER BY idx) AS nth FROM n WHERE rule IN ('rule_1', 'rule_2') AND lang IN ('en-US', '_universal')) WHERE nth <= 2"""
)
def pairs_explanation(spark, sf_dir):
    why = spark.createDataFrame([(r, lang, f"Because {r}") for r in ("rule_1", "rule_2") for lang in ("en-US", "_universal")], "rule string, lang string, explanation string")
    return dataset.explanation_pairs(_templates(spark, sf_dir), why, keep=("idx",)).select("idx", "instruction", "input", "output")


# samples


def _sampled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, "nl-NL").otherwise(lint.languages(F.col("lang"))).alias("lang"), F.col("source").alias("rule"), kind.alias("type"))


_ORDER = "['pt-PT', 'pt-BR', 'en-US', 'en-GB', 'fr-FR', 'de-DE', 'it-IT', 'es-ES', 'es-MX', 'nl-NL', 'nl-BE', 'ro-RO', 'sc', '_universal']"
_S = """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'nl-NL' WHEN lang = 'en' THEN 'en-US' WHEN lang = 'fr' THEN 'fr-FR' WHEN lang = 'de' THEN 'de-DE' WHEN lang = 'es' THEN 'es-ES' END AS lang, source AS rule,
  ['correction', 'detection', 'cross_language', 'explanation'][doc_id % 4 + 1] AS type, doc_id % 4 AS place, doc_id * 2654435761 % 4294967296 AS k FROM documents)"""


@query(
    _S
    + """, h AS (SELECT lang, rule, type, place, count(*) AS have FROM s GROUP BY ALL), b AS (SELECT *, least(CASE WHEN lang = 'nl-NL' THEN 3 ELSE 5 END, sum(have) OVER g) AS budget, count(*) OVER g AS types FROM h WINDOW g AS (PARTITION BY lang, rule)),
w AS (SELECT *, least(greatest(1, budget // types), have) AS want FROM b), q AS (SELECT *, greatest(0, least(want, budget - coalesce(sum(want) OVER (PARTITION BY lang, rule ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM w)
SELECT id, s.lang, s.rule, s.type FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule, type ORDER BY k, id) AS nth FROM s) s JOIN q USING (lang, rule, type) WHERE nth <= quota"""
)
def sample_stratified(spark, sf_dir):
    """A sample by language and rule."""
    return dataset.stratified(_sampled(spark, sf_dir), F.struct(arithmetic_key(), F.col("id"))).select("id", "lang", "rule", "type")


@query(
    _S
    + f""", p AS (SELECT lang, count(*) AS have, list_position({_ORDER}, lang) AS place FROM s GROUP BY lang), t AS (SELECT *, sum(have) OVER () AS total, count(*) OVER () AS langs FROM p),
c AS (SELECT *, least(have, greatest(least(2, 200 // langs), round_even(have / total * 200, 0)::BIGINT)) AS share FROM t), u AS (SELECT *, CASE WHEN total <= 200 THEN have ELSE greatest(0, least(share, 200 - coalesce(sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS own FROM c)
SELECT id, s.lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, id) AS nth FROM s) s JOIN u USING (lang) WHERE nth <= own"""
)
def sample_capped(spark, sf_dir):
    """A sample of at most 200 in all."""
    return dataset.capped(_sampled(spark, sf_dir), F.struct(arithmetic_key(), F.col("id"))).select("id", "lang")


@query("WITH t AS (SELECT greatest(1, length(text) // 4) AS v FROM documents WHERE text IS NOT NULL), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t) SELECT max(v)::BIGINT AS p99, pow(2, ceil(log2(floor(max(v) * 1.1))))::BIGINT AS recommended FROM s WHERE i = floor(n * 0.99::DOUBLE)")
def length_recommendation(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").filter("text is not null").select(dataset.token_estimate(F.col("text")).alias("v"))
    return dataset.length_stats(lengths, "v").select("p99", dataset.recommended(F.col("p99")).alias("recommended"))


@query("SELECT DISTINCT d.source AS rule FROM documents d LEFT JOIN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) l ON l.source = d.source WHERE l.source IS NULL AND d.source IS NOT NULL")
def orphan_sources(spark, sf_dir):
    """Sources without a document labelled toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rule")).filter("rule is not null")
    return dataset.orphans(d, d.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id"), "rule")


@query(
    """WITH w AS (SELECT doc_id, ['r1', 'r2', 'r3', 'r4'][doc_id % 4 + 1] AS rule, ['pt-BR', 'en-US', 'en-GB'][doc_id % 3 + 1] AS lang, CASE WHEN doc_id % 2 = 0 THEN 'ui' END AS register FROM documents)
SELECT doc_id, CASE WHEN rule = 'r1' AND register = 'ui' THEN 'a' WHEN rule = 'r1' AND lang = 'pt-BR' THEN 'c' WHEN rule = 'r2' AND lang = 'en-GB' THEN 'b' WHEN rule IN ('r1', 'r2') THEN 'd' || rule WHEN rule = 'r3' AND lang = 'en-US' THEN 'e' WHEN rule = 'r3' AND lang = 'en-GB' THEN 'e' END AS value,
CASE WHEN rule = 'r1' AND register = 'ui' THEN 'register' WHEN rule = 'r1' AND lang = 'pt-BR' THEN 'parent' WHEN rule = 'r2' AND lang = 'en-GB' THEN 'language' WHEN rule IN ('r1', 'r2') THEN 'universal' WHEN rule = 'r3' AND lang = 'en-US' THEN 'language' WHEN rule = 'r3' AND lang = 'en-GB' THEN 'parent' END AS layer FROM w"""
)
def resolved_values(spark, sf_dir):
    """A setting by register, language, parent language, or for all."""
    values = spark.createDataFrame([("register", "ui", "r1", "a"), ("language", "en-GB", "r2", "b"), ("language", "pt-PT", "r1", "c"), ("universal", "", "r1", "dr1"), ("universal", "", "r2", "dr2"), ("language", "en-US", "r3", "e")], "layer string, name string, rule string, value string")
    parents = spark.createDataFrame([("pt-BR", "pt-PT"), ("en-GB", "en-US")], "lang string, parent string")
    k = F.col("doc_id")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    wanted = table(spark, sf_dir, "documents").select("doc_id", of(("r1", "r2", "r3", "r4")).alias("rule"), of(("pt-BR", "en-US", "en-GB")).alias("lang"), F.when(k % 2 == 0, "ui").alias("register"))
    kinds = dataset.resolve(values, parents, wanted.select("rule", "lang", "register").distinct())
    same = [wanted[c].eqNullSafe(kinds[c]) for c in ("rule", "lang", "register")]
    return wanted.join(kinds, same[0] & same[1] & same[2]).select("doc_id", "value", "layer")


# texts side by side


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN right(text, 30) ELSE left(text, 30) END AS old, CASE WHEN doc_id % 2 = 0 THEN right(text, 30) || '§' ELSE '§' || left(text, 30) END AS new FROM documents WHERE text IS NOT NULL")
def differing_windows(spark, sf_dir):
    """Where two texts differ, with what is round it."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    new = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("§"))).otherwise(F.concat(F.lit("§"), "text"))
    return d.select("doc_id", attribution.differing_window(F.col("text"), new).alias("w")).select("doc_id", "w.old", "w.new")


@query("SELECT page_id, length(url) - k AS same, k AS gone, 2 * k AS added FROM (SELECT page_id, url, (length(url) - length(replace(url, '/', '')))::BIGINT AS k FROM pages)")
def character_diffs(spark, sf_dir):
    """Counts of a character diff by longest common subsequence: signs that become two others."""
    steps = attribution.lcs_diff(F.col("url"), F.replace("url", F.lit("/"), F.lit("§¶")))
    count = lambda op: F.size(F.filter("d", lambda x: x["op"] == op)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", steps.alias("d")).select("page_id", count("equal").alias("same"), count("delete").alias("gone"), count("insert").alias("added"))


_CLEAN = """WITH p AS (SELECT doc_id, text AS t, CASE doc_id % 5 WHEN 0 THEN 'The corrected text is: "' || text || '"' WHEN 1 THEN text || ' (no change needed)' WHEN 2 THEN text || chr(10) || chr(10) || 'Because.' WHEN 3 THEN text || ' The final answer is: z' || chr(10) || 'z' ELSE text || ' [Hinweis: so].' END AS x FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, split_part(x, chr(10) || chr(10), 1) AS x FROM p),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\s*[(\\[](no change|no correction)[^)\\]]*[)\\]]\\.?\\s*$', ''), '(?i)\\s*[(\\[](note|hinweis)\\s*:[^)\\]]*[)\\]]\\.?\\s*$', ''), '(?is)\\s*The final answer is:.*$', ''), '(?i)^The corrected (text|output) is:\\s*["“]?', '') AS x FROM a)
SELECT doc_id, trim(regexp_replace(x, '["”]?\\s*$', ''), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM b"""


@query(_CLEAN)
def cleaned_predictions(spark, sf_dir):
    d, k, t = table(spark, sf_dir, "documents").filter("text is not null"), F.col("doc_id") % 5, F.col("text")
    x = F.when(k == 0, F.concat(F.lit('The corrected text is: "'), t, F.lit('"'))).when(k == 1, F.concat(t, F.lit(" (no change needed)"))).when(k == 2, F.concat(t, F.lit("\n\nBecause."))).when(k == 3, F.concat(t, F.lit(" The final answer is: z\nz"))).otherwise(F.concat(t, F.lit(" [Hinweis: so].")))
    return d.select("doc_id", evaluation.clean_prediction(x).alias("cleaned"))


# the judged sentences, by the linter

_MISSED = "(12, 13, 14, 31, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 70, 71, 72)"


def judged(spark, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The 83 sentences, linted and scored."""
    cases = eval_cases.cases(spark)
    done = lint.lint_text(cases, "input", "language", out="predicted", extensions=extensions)
    return evaluation.score(done, cleaned=False, batches=eval_cases.BATCHES)


@query(f"SELECT i::INTEGER AS case_id, i NOT IN {_MISSED} AS exact_match, false AS regression FROM range(83) AS x(i)")
def judged_cases(spark, sf_dir):
    return judged(spark).select("case_id", "exact_match", "regression")


@query(
    """SELECT * FROM (VALUES ('all', '', 83, 66, 0), ('language', 'de-DE', 15, 11, 0), ('language', 'en-GB', 4, 3, 0), ('language', 'en-US', 27, 22, 0), ('language', 'es-ES', 5, 3, 0), ('language', 'es-MX', 1, 1, 0), ('language', 'fr-FR', 21, 17, 0), ('language', 'it-IT', 3, 2, 0),
('language', 'pt-PT', 4, 4, 0), ('language', 'ro-RO', 3, 3, 0), ('batch', '0', 19, 16, 0), ('batch', '1', 8, 8, 0), ('batch', '2', 14, 13, 0), ('batch', '3', 14, 14, 0), ('batch', '4', 19, 6, 0), ('batch', '5', 5, 5, 0), ('batch', '6', 4, 4, 0)) AS x(grouping_name, grp, n, exact, regressions)"""
)
def judged_rollup(spark, sf_dir):
    """In all, by language and by batch."""
    done = evaluation.rollup(judged(spark)).filter("grouping_name <> 'rule'")
    return done.select("grouping_name", "grp", *[F.col(c).cast("int").alias(c) for c in ("n", "exact", "regressions")])


@query(f"SELECT i::INTEGER AS case_id FROM range(83) AS x(i) WHERE i IN {_MISSED}")
def judged_failures(spark, sf_dir):
    return evaluation.failures(judged(spark)).select("case_id")


@query("SELECT * FROM (VALUES ('exact', 66.0::DOUBLE, 83.0::DOUBLE, 17.0::DOUBLE), ('exact_pct', 79.5, 100.0, 20.5), ('regressions', 0.0, 0.0, 0.0)) AS x(metric, a, b, delta)")
def judged_with_extensions(spark, sf_dir):
    """The default chain against all usual extensions."""
    from glyphmill.functions.extensions import USUAL

    more = tuple(n for n in USUAL if n != "initials_exemption")
    return evaluation.overall(judged(spark), judged(spark, more)).filter("metric <> 'mean_similarity'")
