"""Quality rules with risk-controlled thresholds.

Each rule scores a document (higher is worse) and rejects it above a cutoff. Cutoffs come from labelled
holdouts, stratum by stratum. All rules together go through one fixed sequence of settings, from loose to
tight: at step p each rule stands at its p-th cutoff, or at its tightest if it has fewer. A step is certified
if the exact binomial probability of so few documents rejected by any rule among the stratum's good ones, were
the true false-rejection rate at the limit, is at most the error level divided by the number of strata.
Testing stops at the first failure, so a fixed sequence needs no correction along it. Looser cutoffs than
those of a certified step reject fewer documents, so each rule may then take its own. So with
probability ``1 - error`` no stratum loses more than ``risk`` of its good documents to the rules together.
Where labels are too few to prove anything (four strata: 86 good documents), the rules reject nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from segpanel.llm.stage import staged

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Insulting words, counted as whole words in any case. Other insults are not seen.
INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "imbeciles", "stupid", "dumbass", "trash", "scum", "scumbag",
    "loser", "losers", "pathetic", "disgusting", "worthless", "clown", "clowns", "asshole", "assholes", "bastard", "bastards", "bitch",
    "bitches", "retard", "retarded",  # en
    "idioten", "trottel", "dummkopf", "dumm", "schwachkopf", "abschaum", "versager", "erbärmlich", "ekelhaft", "wertlos", "arschloch",
    "arschlöcher", "vollidiot", "drecksack", "depp", "schlampe",  # de
    "idiote", "idiotes", "imbécile", "imbéciles", "stupide", "stupides", "crétin", "crétins", "abruti", "abrutis", "connard", "connards",
    "connasse", "salaud", "salope", "ordure", "ordures", "pathétique", "dégoûtant", "minable", "minables",  # fr
    "idiota", "idiotas", "imbécil", "imbéciles", "estúpido", "estúpida", "estúpidos", "estúpidas", "tonto", "tonta", "basura", "escoria",
    "perdedor", "patético", "patética", "asqueroso", "asquerosa", "inútil", "payaso", "cabrón", "gilipollas", "pendejo",  # es
)
#: Stands for all rules together.
ALL = ""
#: Strata are broadcast if they are at most so many; otherwise their table is joined by a shuffle.
BROADCAST_STRATA = 2_000

INSULT = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(set(INSULTS))) + r")(?![\p{L}\p{N}])"


@dataclass(frozen=True)
class Rule:
    """``score`` is SQL over the feature columns, ``cutoffs`` go from loose to tight."""

    name: str
    score: str
    cutoffs: tuple[float, ...]


_SHARES = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01)
RULES = (
    Rule("symbols", "n_symbols / n_words", (4.0, 2.0, 1.5, 1.0, *_SHARES)),
    Rule("shouting", "n_upper / word_chars", _SHARES),
    Rule("exclaiming", "n_exclaim / n_words", (4.0, 2.0, 1.0, *_SHARES)),
    Rule("lines_again", "n_dup_lines / n_lines", _SHARES),
    Rule("words_again", "n_repeat_words / n_words", _SHARES),
    Rule("long_words", "word_chars / n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    Rule("insults", "n_insults / n_words", (0.1, 0.05, 0.03, 0.02, 0.015, 0.01, 0.0075, 0.005, 0.003, 0.002, 0.001, 0.0005, 0.0)),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_insults")


def _pairs(a: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on."""
    n = F.size(a) - step
    return F.zip_with(F.slice(a, 1, n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def _characters(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def with_features(docs: DataFrame) -> DataFrame:
    """Add ``FEATURES`` (long), computed from the whole ``text`` inside its row; null counts as empty.

    Windows are hashed by doubling (2, 4, 8 words), so a long text costs time in proportion; only
    texts with a repeated window are sorted. Existing columns of these names are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.drop(*FEATURES).withColumn("_bare", F.btrim(text, F.lit(SPACES)))
    out = out.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", SPACE)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("_lines", lines).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": _characters(text, SYMBOLS).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_exclaim": _characters(text, "!").cast("long"),
        "n_insults": F.regexp_count(F.lower(text), F.lit(INSULT)).cast("long"),
    })
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn(
        "n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_w", F.when(F.size("_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(none))
    for step in (1, 2, 4):
        out = out.withColumn("_w", F.when(F.size("_w") > 0, _pairs(F.col("_w"), step)).otherwise(none))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    out = out.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    out = out.withColumn("_next", F.zip_with(
        "_sorted", F.slice("_sorted", F.lit(2), F.size("_sorted")), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))))
    out = out.withColumn("_either", F.zip_with(
        "_next", F.concat(F.array(F.lit(False)), F.slice("_next", F.lit(1), F.size("_next") - 1)), lambda a, b: a | b))
    out = out.withColumn("_at", F.array_sort(F.transform(F.filter(
        F.arrays_zip(F.col("_sorted").alias("s"), F.col("_either").alias("e")), lambda z: z["e"]), lambda z: z["s"]["i"])))
    new = F.zip_with(F.slice("_at", F.lit(1), F.size("_at") - 1), F.slice("_at", F.lit(2), F.size("_at") - 1),
                     lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    out = out.withColumn("n_repeat_words", F.when(again, F.aggregate(new, F.lit(WINDOW).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long"))
    return out.drop("_bare", "_words", "_lines", "_w", "_sorted", "_next", "_either", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _score(rule: Rule) -> Column:
    """0 where the score has no value (no words)."""
    numerator, denominator = rule.score.split(" / ")
    return F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(F.lit(0.0))


def critical_count(n: Column, rate: Column, error: Column) -> Column:
    """The largest x with P(Binomial(n, rate) <= x) <= error; -1 if there is none.

    Exact: terms follow from each other by logarithms, up to x = n * rate at most, where the
    probability is near one half.
    """
    def grow(a: Column, k: Column) -> Column:
        log = a["log"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double")) + F.log(rate) - F.log(1 - rate)
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"),
                        F.when(total <= error, k).otherwise(a["at"]).alias("at"))
    start = n * F.log(1 - rate)
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(n * rate), F.lit(1)).cast("long")),
        F.struct(start.alias("log"), F.exp(start).alias("sum"),
                 F.when(F.exp(start) <= error, F.lit(0).cast("long")).otherwise(F.lit(-1).cast("long")).alias("at")),
        grow, lambda a: a["at"])


def certified_cutoffs(scored: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff: certified cutoffs, at most one for each stratum and rule.

    ``scored`` has doc_id, stratum, text_hash and ``FEATURES`` and is a written table. Documents that the
    base rules reject take no part. Equal texts of a stratum count once, so that copies don't pose as
    independent evidence. A text is good if a label gives it quality 1 and none says that it is toxic; other
    texts with a quality or a toxic label count as bad. Of the cutoffs up to the last certified step, each rule takes the loosest that still rejects 99 of 100 of the bad documents that
    its tightest one rejects. Cutoffs that reject as many good labelled documents as bad ones are left out.
    """
    marks = labels.filter("doc_id is not null and (quality is not null or toxic = 1)").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    held = scored.filter(~base_failed()).join(marks, "doc_id").groupBy("stratum", "text_hash").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), *[F.max(f).alias(f) for f in FEATURES])
    held = held.withColumn("good", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int"))
    # Number of steps, from the loosest on, that let the document pass: by each rule, and by all (ALL).
    steps = max(len(r.cutoffs) for r in rules)
    paths = {r.name: [*r.cutoffs, *[r.cutoffs[-1]] * (steps - len(r.cutoffs))] for r in rules}
    held = held.select("stratum", "good", *[sum(((_score(r) <= c).cast("int") for c in paths[r.name]), F.lit(0)).alias(f"_{r.name}") for r in rules])
    bins = F.array(
        F.struct(F.lit(ALL).alias("rule"), F.array_min(F.array(*[F.col(f"_{r.name}") for r in rules])).alias("passing")),
        *[F.struct(F.lit(r.name).alias("rule"), F.col(f"_{r.name}").alias("passing")) for r in rules])
    counts = held.select("stratum", "good", F.inline(bins)).groupBy("stratum", "rule", "passing").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad"))
    counts = staged(counts, "rule-counts")
    # From here on there is a row for each stratum, rule and step.
    strata = counts.agg(F.countDistinct("stratum")).scalar()
    # The step at place p (from 0, the loosest first) rejects the documents that pass at most p steps.
    grid = counts.select("stratum", "rule").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    tried = grid.join(counts, ["stratum", "rule"]).groupBy("stratum", "rule", "p").agg(
        F.sum("good").alias("n"),
        F.sum(F.when(F.col("passing") <= F.col("p"), F.col("good")).otherwise(0)).alias("wrong"),
        F.sum(F.when(F.col("passing") <= F.col("p"), F.col("bad")).otherwise(0)).alias("right"))
    by_step = Window.partitionBy("stratum").orderBy("p")
    certified = tried.filter(F.col("rule") == ALL).withColumn("strata", strata).withColumn(
        "most", critical_count(F.col("n"), F.lit(risk), F.lit(error) / F.col("strata"))).withColumn(
        "ok", F.min((F.col("wrong") <= F.col("most")).cast("int")).over(by_step)).filter("ok = 1").select("stratum", "p")
    cutoffs = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.name), F.array(*map(F.lit, paths[r.name])))]), F.col("rule"))
    passed = tried.filter(F.col("rule") != ALL).join(certified, ["stratum", "p"])
    passed = passed.filter("right > wrong")  # a cutoff that rejects more good documents than bad ones is of no use
    best = F.max("right").over(Window.partitionBy("stratum", "rule"))
    return passed.withColumn("cutoff", F.element_at(cutoffs, F.col("p") + 1)).withColumn("best", best).filter(
        "right >= 0.99 * best").groupBy("stratum", "rule").agg(F.max("cutoff").alias("cutoff"))


def verdict(rows: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed and kept to rows with ``stratum`` and ``FEATURES``; ``cutoffs`` is a written table."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in rules])
    small = cutoffs.select("stratum").distinct().limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = rows.join(F.broadcast(wide) if small else wide, "stratum", "left")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(_score(r) > F.col(f"_cut_{r.name}"), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop(
        *[f"_cut_{r.name}" for r in rules])


def _stratum() -> Column:
    """Documents without language are a stratum of their own."""
    return F.coalesce("lang", F.lit(""))


def scored_documents(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """doc_id, stratum, text_hash, ``FEATURES`` and, if asked for, row (``columns`` as one value), written once: features are computed but once."""
    row = [F.struct(*columns).alias("row")] if columns else []
    rows = with_features(docs.select(*row, "doc_id", "text", "lang"))
    kept = ["row"] if columns else []
    return staged(rows.select("doc_id", _stratum().alias("stratum"), F.xxhash64("text").alias("text_hash"), *FEATURES, *kept), "features")


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, FEATURES, base_failed, kept for every row of ``docs``; repeated rows get a verdict each.

    Null and empty texts have no words and fail the base rules; a long text is read whole, inside its row. A document with several labels
    counts with the greatest quality, and as toxic if one of them says so. Without labels, or with too few, the base rules decide
    alone; an empty table gives no rows. Other columns are not looked at.
    """
    scored = scored_documents(docs)
    cutoffs = staged(certified_cutoffs(scored, labels, risk=risk, error=error), "cutoffs")
    return verdict(scored, cutoffs).select("doc_id", "stratum", *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; no row is shuffled for it.

    What ``quality_verdicts`` says of nulls, long texts, labels and empty tables holds here too.
    """
    scored = scored_documents(docs, docs.columns)
    cutoffs = staged(certified_cutoffs(scored.drop("row"), labels, risk=risk, error=error), "cutoffs")
    return verdict(scored, cutoffs).filter("kept").select("row.*")
