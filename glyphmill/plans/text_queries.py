"""Queries over whole tables of the operators that aren't single rules: linting, fonts, attribution, evaluation, data sets.

The corpus is almost clean, therefore most queries put the same noise into every text on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import dims, fonts, masking
from glyphmill.operators import attribution, dataset, evaluation
from glyphmill.operators.font_gate import Gate, tier_counts
from glyphmill.plans import lint
from glyphmill.plans.rule_queries import q

TAIL = ' He said "no" to 10kg of tea...  pp. 10-20 (c) 2020, see `x = "y"` at http://a.example/b?c="d" or mail a.b@c.example. 3x4 isn\'t 1/2.'
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.concat(F.replace("text", F.lit(", "), F.lit(" - ")), F.lit(TAIL)).alias("text"))


LANGS = list(dims.LOCALES.values())


# linting


@query()
def lint_full(spark, sf_dir):
    """All texts corrected by all rules of their languages."""
    return lint.lint_text(noised(spark, sf_dir), langs=LANGS).select("doc_id", "corrected")


@query()
def lint_strict(spark, sf_dir):
    return lint.lint_text(noised(spark, sf_dir), strict=True, langs=LANGS).select("doc_id", "corrected")


@query()
def lint_log(spark, sf_dir):
    """Each correction of each text."""
    return lint.lint_log(noised(spark, sf_dir)).select("doc_id", F.explode("lint.corrections").alias("c")).select("doc_id", "c.*")


@query()
def lint_stats_by_lang_rule(spark, sf_dir):
    return lint.stats(lint.lint_log(noised(spark, sf_dir)), ["lang"])


@query()
def change_rate_by_source(spark, sf_dir):
    done = lint.lint_text(lint.spread(table(spark, sf_dir, "documents")), langs=LANGS)
    return done.groupBy("source").agg(F.count("*").alias("docs"), F.sum((F.col("corrected") != F.col("text")).cast("long")).alias("changed"))


@query()
def mask_spans(spark, sf_dir):
    return noised(spark, sf_dir).select("doc_id", F.explode(masking.regions(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query()
def mask_kinds_of_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(masking.regions(F.col("html"))).alias("s")).groupBy("s.kind").agg(F.count("*").alias("n"))


# fonts

MIXED = " “quoted” — ½ ş ș … → ″ ﬁ ‽ ⁦x⁩"


def _mixed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(MIXED)).alias("text"))


ASCII = Gate(range(0x20, 0x7F))


def _process_sql() -> str:
    x = f"(text || {q(MIXED)})"
    for cp in ASCII.missing:
        new = "" if cp in ASCII.dropped else ASCII.fallbacks[cp][0] if cp in ASCII.fallbacks else None
        if new is not None and chr(cp) != new:
            x = f"replace({x}, chr({cp}), {q(new)})"
    return f"SELECT doc_id, {x} AS shown FROM documents"


@query(_process_sql())
def gate_process(spark, sf_dir):
    """Texts as a font with ASCII alone can show them."""
    return _mixed(spark, sf_dir).select("doc_id", ASCII.process(F.col("text")).alias("shown"))


def _tier_sql() -> str:
    count = lambda t: "len(regexp_extract_all(x, '[" + "".join(f"\\x{{{cp:x}}}" for cp in sorted(fonts.TIERS[t])) + "]'))"
    return f"SELECT doc_id, {', '.join(f'{count(t)}::BIGINT AS tier_{t}' for t in fonts.TIERS)} FROM (SELECT doc_id, text || {q(MIXED)} AS x FROM documents)"


@query(_tier_sql())
def gate_tier_counts(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in tier_counts(F.col("text")).items()])


_TRACKED = ", ".join(f"({cp}, {fonts.tier(cp)})" for cp in sorted(set().union(*fonts.TIERS.values()) | fonts.CHAINS.keys()))


@query(
    f"""WITH dim(cp, tier) AS (VALUES {_TRACKED}),
chars AS (SELECT unnest(string_split(text || {q(MIXED)}, '')) AS ch FROM documents)
SELECT ch, d.cp::INTEGER AS cp, d.tier::INTEGER AS tier, count(*)::BIGINT AS occurrences FROM chars JOIN dim d ON unicode(ch) = d.cp GROUP BY ALL"""
)
def gate_report(spark, sf_dir):
    """Occurrences of tracked characters in the corpus."""
    return Gate().report(_mixed(spark, sf_dir), [], "text").select("ch", "cp", "tier", "occurrences")


@query()
def gate_log(spark, sf_dir):
    return Gate().log(_mixed(spark, sf_dir), "doc_id", "text")


LATIN1 = Gate([*range(0x20, 0x7F), *range(0xA0, 0x100)])
_MEMBERS = ", ".join(f"({cp}, {t})" for t, members in fonts.TIERS.items() for cp in sorted(members))


@query(
    f"""WITH dim(cp, tier) AS (VALUES {_MEMBERS}), s AS (SELECT tier, (cp BETWEEN 32 AND 126 OR cp BETWEEN 160 AND 255)::INTEGER AS has FROM dim)
SELECT tier::INTEGER AS tier, count(*)::BIGINT AS total, sum(has)::BIGINT AS supported, round(sum(has) / count(*) * 100, 1) AS coverage_pct FROM s GROUP BY tier"""
)
def gate_coverage(spark, sf_dir):
    """How much of each tier a Latin-1 font covers."""
    return LATIN1.coverage(spark).drop("missing")


@query(
    f"""WITH dim(cp, tier) AS (VALUES {_MEMBERS}), s AS (SELECT tier, count(*) AS n, sum((cp BETWEEN 32 AND 126 OR cp BETWEEN 160 AND 255)::INTEGER) AS has FROM dim GROUP BY tier)
SELECT sum(n)::BIGINT AS total, sum(has)::BIGINT AS supported, round(sum(has) / sum(n) * 100, 1) AS overall_pct, round(sum((5 - tier) * has / n) / sum(5 - tier) * 100, 1) AS readiness_pct FROM s"""
)
def gate_readiness(spark, sf_dir):
    return LATIN1.readiness(spark)


# attribution

_PAIRS = ('"=“', "'=’", "--=—", "...=…", "-=–", "ş=ș", "SS=ẞ", "(c)=©", "x=×", "->=→", "1/2=½", "oe=œ", "b=c", " =\u00a0")


def _hunks(spark, sf_dir) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p.rpartition("=")[0]).alias("original"), F.lit(p.rpartition("=")[2]).alias("corrected")) for p in _PAIRS])
    docs = table(spark, sf_dir, "documents").select("doc_id", lint.languages(F.col("lang")).alias("lang"))
    return docs.withColumn("h", F.element_at(pairs, (F.col("doc_id") % len(_PAIRS) + 1).cast("int"))).select("doc_id", "lang", "h.*")


_RULES = {'"': "quotation", "'": "quotation", "...": "ellipsis", "-": "range_dash", "(c)": "legal_symbols", "x": "dimensions", "->": "arrow_symbols", "1/2": "fractions", " ": "number_unit_spacing"}
_BY_LANG = {"--": ("en", "parenthetical_dash"), "ş": ("ro", "diacritic_correctness"), "SS": ("de", "capital_sharp_s"), "oe": ("fr", "french_ligatures")}
_OWN = " ".join(f"WHEN a = {q(a)} THEN '{r}'" for a, r in _RULES.items()) + " WHEN a = '--' AND lang IN ('fr', 'es') THEN 'dialogue_attribution' " + " ".join(f"WHEN a = {q(a)} AND lang = '{lang}' THEN '{r}'" for a, (lang, r) in _BY_LANG.items())
_ORIGINALS = f"WITH h AS (SELECT doc_id, lang, [{', '.join(q(p.rpartition('=')[0]) for p in _PAIRS)}][doc_id % {len(_PAIRS)} + 1] AS a FROM documents)"


@query(f"{_ORIGINALS} SELECT doc_id, CASE {_OWN} END AS rule FROM h")
def attribute_rule(spark, sf_dir):
    """The rule of one given change a document."""
    return attribution.annotate(_hunks(spark, sf_dir)).select("doc_id", "rule")


@query(f"{_ORIGINALS} SELECT coalesce(CASE {_OWN} END, 'unmatched') AS rule, count(*)::BIGINT AS n FROM h GROUP BY ALL")
def attribution_summary(spark, sf_dir):
    return attribution.summary(attribution.annotate(_hunks(spark, sf_dir)), [])


@query()
def attribute_changes(spark, sf_dir):
    """What linting changed in each text, by character diff, and the rule of each change."""
    done = lint.lint_text(noised(spark, sf_dir), langs=LANGS)
    each = done.select("doc_id", lint.languages(F.col("lang")).alias("lang"), F.explode(attribution.changes(F.col("text"), F.col("corrected"))).alias("h"))
    return attribution.annotate(each.select("doc_id", "lang", "h.*"))


@query("SELECT doc_id, replace(replace(text || ' a' || chr(160) || 'b' || chr(8239) || 'c' || chr(8203), chr(160), '[NBSP]'), chr(8239), '[NNBSP]').replace(chr(8203), '[ZWSP]') AS shown FROM documents")
def visible_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", attribution.visible(F.concat("text", F.lit(" a\u00a0b\u202fc\u200b"))).alias("shown"))


# data sets: pairs of a user's and an assistant's turn


def records(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    a = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    b = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    own = F.struct(F.lit("correction").alias("type"), F.lit("turn").alias("rule"), F.lit("en-US").alias("language"), F.lit(None).cast("string").alias("register"), F.lit(None).cast("string").alias("source_language"), F.lit(None).cast("string").alias("target_language"))
    text = F.when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(F.lit("Answer the question."))
    return a.join(b, ["conv_id", "turn"], "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("lineno"), text.alias("instruction"), "input", "output", own.alias("metadata"))


_RECORDS = "WITH r AS (SELECT a.conv_id * 1000 + a.turn AS lineno, CASE WHEN a.conv_id % 7 = 0 THEN '' ELSE 'Answer the question.' END AS instruction, a.text AS input, b.text AS output FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"


@query(
    f"""{_RECORDS} SELECT lineno, unnest(CASE WHEN input IS NULL OR output IS NULL THEN list_filter([CASE WHEN input IS NULL THEN 'missing_input' END, CASE WHEN output IS NULL THEN 'missing_output' END], lambda v: v IS NOT NULL)
ELSE list_filter([CASE WHEN instruction = '' THEN 'empty_instruction' END, CASE WHEN regexp_full_match(output, '\\s*') THEN 'empty_output' END, CASE WHEN input = output AND input <> '' THEN 'no_signal' END], lambda v: v IS NOT NULL) END) AS issue FROM r"""
)
def dataset_issues(spark, sf_dir):
    return dataset.issues(records(spark, sf_dir))


@query(f"{_RECORDS} SELECT * FROM (SELECT lineno, min(lineno) OVER (PARTITION BY instruction, input, output) AS first_lineno FROM r) WHERE lineno > first_lineno")
def dataset_duplicates(spark, sf_dir):
    return dataset.duplicates(records(spark, sf_dir)).select("lineno", "first_lineno")


@query(f"{_RECORDS} SELECT 'type' AS dimension, 'correction' AS value, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'language', 'en-US', count(*) FROM r UNION ALL SELECT 'rule', 'turn', count(*) FROM r")
def dataset_counts(spark, sf_dir):
    return dataset.counts(records(spark, sf_dir))


@query(f"{_RECORDS} SELECT instruction, count(*)::BIGINT AS n, min(lineno) AS first_lineno FROM r GROUP BY instruction ORDER BY n DESC, first_lineno LIMIT 10")
def dataset_top_instructions(spark, sf_dir):
    """A top-k report."""
    return dataset.top(records(spark, sf_dir), "instruction", 10)


_LENGTHS = "WITH t AS (SELECT greatest(1, length(text) // 4)::BIGINT AS v FROM documents WHERE text IS NOT NULL), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t)"


def _lengths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select(dataset.token_estimate(F.col("text")).alias("v"))


@query(
    f"""{_LENGTHS} SELECT max(n) AS n, min(v) AS min_len, round(sum(v) / max(n), 4) AS mean_len, (max(CASE WHEN i = (n - 1) // 2 THEN v END) + max(CASE WHEN i = n // 2 THEN v END)) / 2 AS median_len,
max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN v END) AS p95, max(CASE WHEN i = floor(n * 0.99::DOUBLE) THEN v END) AS p99, max(v) AS max_len FROM s"""
)
def length_percentiles(spark, sf_dir):
    return dataset.length_stats(_lengths(spark, sf_dir), "v")


@query(f"{_LENGTHS} SELECT b::INTEGER AS bucket, sum((v <= b)::INTEGER)::BIGINT AS n, round(sum((v <= b)::INTEGER) * 100 / count(*), 1) AS pct FROM t, (VALUES (32), (64), (128), (256), (512), (1024), (2048)) AS x(b) GROUP BY b")
def length_buckets(spark, sf_dir):
    return dataset.buckets(_lengths(spark, sf_dir), "v")


@query(f"{_RECORDS} SELECT lineno, CASE WHEN coalesce(input, '') = '' THEN instruction ELSE instruction || chr(10) || chr(10) || input END AS asked, output AS answered FROM r")
def chat_records(spark, sf_dir):
    m = dataset.chat_messages(F.col("instruction"), F.col("input"), F.col("output"))
    return records(spark, sf_dir).withColumn("m", m).select("lineno", F.col("m")[0]["content"].alias("asked"), F.col("m")[1]["content"].alias("answered"))


def arithmetic_key(c: str = "id") -> Column:
    """An order that SQL can repeat."""
    return (F.col(c) * F.lit(2654435761)) % F.lit(1 << 32)


@query(
    """WITH g AS (SELECT doc_id AS id, lang AS language, source AS rule, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id * 2654435761 % 4294967296, doc_id) AS r FROM documents)
SELECT id, CASE WHEN r <= CASE WHEN n < 3 THEN 1 ELSE greatest(1, round_even(n * 0.1::DOUBLE, 0)) END THEN 'valid' ELSE 'train' END AS split FROM g"""
)
def split_train_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("rule"))
    return dataset.split(rows, arithmetic_key(), F.col("id")).select("id", "split")


def _templates(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("rule_"), F.col("doc_id") % 5).alias("rule"), F.when(F.col("doc_id") % 11 == 0, "_universal").otherwise(lint.languages(F.col("lang"))).alias("lang"), F.col("doc_id").alias("idx"), F.concat("text", F.lit("...")).alias("raw"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("..."))).otherwise(F.concat("text", F.lit("…"))).alias("correct"))


_NAMED = "CASE lang WHEN 'en' THEN 'American English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'European Spanish' END"


@query(
    f"""SELECT doc_id AS idx, 'Correct the typography in the following ' || CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_NAMED} || ' ' END || 'text' || u || '. Output only the corrected text, no explanation.' AS instruction, text || '...' AS input, text || '…' AS output
FROM documents, (VALUES (''), (' for editorial use'), (' for marketing use')) AS x(u) WHERE doc_id % 3 <> 0 AND text IS NOT NULL"""
)
def pairs_correction(spark, sf_dir):
    t = _templates(spark, sf_dir)
    made = dataset.correction_pairs(t.withColumn("rule", F.col("idx").cast("string")))
    return made.select(F.col("metadata.rule").cast("long").alias("idx"), "instruction", "input", "output")


# evaluation


def cases(spark, sf_dir, run: int = 0) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    predicted = F.when((F.col("doc_id") + run) % 4 == 0, F.concat("text", F.lit(" wrong"))).otherwise(F.concat(F.lit("  "), "text"))
    return d.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("language"), F.col("source").alias("rule"), F.col("text").alias("input"), F.trim(F.col("text")).alias("expected"), predicted.alias("predicted"))


_CASES = "WITH c AS (SELECT doc_id AS case_id, lang AS language, source AS rule, (doc_id % 4 <> 0)::BIGINT AS x, ((doc_id + 1) % 4 <> 0)::BIGINT AS y FROM documents WHERE text IS NOT NULL)"


def _scored(spark, sf_dir, run: int = 0) -> DataFrame:
    return evaluation.score(cases(spark, sf_dir, run), cleaned=False, with_similarity=False)


@query(f"{_CASES} SELECT 'all' AS grouping_name, '' AS grp, count(*)::BIGINT AS n, sum(x)::BIGINT AS exact FROM c UNION ALL SELECT 'language', language, count(*), sum(x)::BIGINT FROM c GROUP BY language UNION ALL SELECT 'rule', rule, count(*), sum(x)::BIGINT FROM c GROUP BY rule UNION ALL SELECT 'batch', '-1', count(*), sum(x)::BIGINT FROM c")
def eval_rollup(spark, sf_dir):
    return evaluation.rollup(_scored(spark, sf_dir))


@query(f"{_CASES} SELECT language, count(*)::BIGINT AS n, sum(x)::BIGINT AS exact_a, sum(y)::BIGINT AS exact_b, (sum(y) - sum(x))::BIGINT AS delta FROM c GROUP BY language")
def eval_compare(spark, sf_dir):
    return evaluation.compare(_scored(spark, sf_dir), _scored(spark, sf_dir, 1))


@query(f"{_CASES} SELECT case_id, language, rule, CASE WHEN y = 1 THEN 'gained' ELSE 'lost' END AS change FROM c WHERE x <> y")
def eval_gained_lost(spark, sf_dir):
    return evaluation.gained_lost(_scored(spark, sf_dir), _scored(spark, sf_dir, 1))

