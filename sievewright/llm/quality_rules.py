"""Quality rules as weak supervision, in DataFrame and SQL expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on counts of the text. The
votes of all documents that the base rules leave open are counted by vote
pattern; there are at most 3 to the number of rules such patterns, whatever the
corpus, and expectation-maximisation runs on this small table: each round is one aggregate whose sums become the next
round's parameters. It estimates for both classes how often each rule votes good,
bad or not at all (its accuracy), and the share of good documents; rules are
taken as independent given the class. A document is kept if its posterior
probability of being good is at least ``threshold`` and no base rule forbids it.

Defined cases: a null or empty text has no words, so the base rule drops it; with
an empty table the priors stay and the result is empty; null ids are carried;
repeated rows count and are returned each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .features import FEATURES_SQL, text_features

#: name: (condition for a good vote, condition for a bad vote), SQL over integer counts.
RULES = {
    "symbols": ("n_symbols * 50 <= n_words", "n_symbols * 10 > n_words"),
    "upper": ("n_upper * 4 < n_letters", "n_upper * 2 > n_letters"),
    "repeats": ("n_repeat_words * 20 <= n_words", "n_repeat_words * 5 > n_words"),
    "dup_lines": ("n_dup_lines = 0", "n_dup_lines > 2"),
    "stop_words": ("n_stop * 10 >= n_words", "n_stop * 50 < n_words"),
    "exclaims": ("n_bang * 50 <= n_words", "n_bang * 5 > n_words"),
    "word_length": ("word_chars BETWEEN n_words * 3 AND n_words * 9", "word_chars < n_words * 2 OR word_chars > n_words * 12"),
    "variety": ("n_distinct * 3 >= n_words", "n_distinct * 8 < n_words"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ROUNDS = 12
#: Pseudo-votes for each outcome: no estimated rate is ever 0.
PRIOR = 1.0
#: A first guess: the share of patterns' net votes.
FIRST = "1 / (1 + exp(-1.5 * (" + " + ".join(f"v_{r}" for r in RULES) + " - 3)))"
_OUT = (1, -1, 0)
_NAME = {1: "p", -1: "n", 0: "z"}


def vote_sql(rule: str) -> str:
    good, bad = RULES[rule]
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def _sums(p: str) -> dict[str, str]:
    """Aggregates of one round, given the SQL of a pattern's posterior."""
    out = {"s_g": f"sum(c * {p})", "s_b": f"sum(c * (1 - {p}))"}
    for r in RULES:
        for v in _OUT:
            out[f"g_{r}_{_NAME[v]}"] = f"sum(CASE WHEN v_{r} = {v} THEN c * {p} ELSE 0 END)"
            out[f"b_{r}_{_NAME[v]}"] = f"sum(CASE WHEN v_{r} = {v} THEN c * (1 - {p}) ELSE 0 END)"
    return out


def _posterior(of) -> str:
    """SQL of the posterior; ``of`` gives the SQL of a sum by its name."""
    odds = [f"ln(({of('s_b')} + {PRIOR}) / ({of('s_g')} + {PRIOR}))"]
    for r in RULES:
        cases = " ".join(
            f"WHEN v_{r} = {v} THEN ln(({of(f'b_{r}_{_NAME[v]}')} + {PRIOR}) / ({of('s_b')} + {3 * PRIOR}))"
            f" - ln(({of(f'g_{r}_{_NAME[v]}')} + {PRIOR}) / ({of('s_g')} + {3 * PRIOR}))"
            for v in _OUT
        )
        odds.append(f"CASE {cases} END")
    return "1 / (1 + exp(" + " + ".join(odds) + "))"


def label_quality(documents: DataFrame, *, rounds: int = ROUNDS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, float]]:
    """(per document the counts, the votes v_<rule>, quality_prob, base_failed
    and kept; the estimated sums, from which the accuracies follow)."""
    spark = documents.sparkSession
    counts = text_features(documents, id_col=id_col, text_col=text_col)
    votes, _ = written(counts.select("*", *(F.expr(vote_sql(r)).alias(f"v_{r}") for r in RULES)), "votes")
    names = [f"v_{r}" for r in RULES]
    patterns, at = written(votes.where(f"NOT ({BASE_FAILED})").groupBy(*names).agg(F.count("*").cast("double").alias("c")).coalesce(1), "patterns")
    state: dict[str, float] = {}
    posterior = FIRST
    for _ in range(rounds):
        shared = patterns.select("*", F.expr(posterior).alias("p"))
        row = shared.agg(*(F.coalesce(F.expr(sql), F.lit(0.0)).alias(k) for k, sql in _sums("p").items())).first()
        state = row.asDict()
        posterior = _posterior(lambda k: f"CAST({state[k]!r} AS DOUBLE)")
    discard(spark, at)
    labelled = votes.select(
        "*", F.expr(posterior).alias("quality_prob"), F.expr(BASE_FAILED).alias("base_failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))
    return labelled, state


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document."""
    labelled, _ = label_quality(table(spark, sf_dir, "documents"))
    return labelled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality_prob", 3).alias("quality_prob"),
    )


def _oracle() -> str:
    names = ", ".join(f"v_{r}" for r in RULES)
    parts = [
        FEATURES_SQL,
        f"votes AS (SELECT *, {', '.join(f'{vote_sql(r)} AS v_{r}' for r in RULES)} FROM feat)",
        f"pat AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS c FROM votes WHERE NOT ({BASE_FAILED}) GROUP BY ALL)",
    ]
    posterior = FIRST
    for k in range(ROUNDS):
        source = "pat" if k == 0 else f"pat, e{k - 1}"
        sums = ", ".join(f"coalesce({sql}, 0.0) AS {name}" for name, sql in _sums("p").items())
        parts.append(f"e{k} AS MATERIALIZED (SELECT {sums} FROM (SELECT pat.*, {posterior} AS p FROM {source}))")
        posterior = _posterior(lambda name: name)
    last = ROUNDS - 1
    return (
        "WITH " + ",\n".join(parts) + f""",
post AS (SELECT votes.*, {posterior} AS quality_prob, {BASE_FAILED} AS base_failed FROM votes, e{last})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND quality_prob >= 0.5 AS kept, round(quality_prob, 3) AS quality_prob FROM post"""
    )


ORACLE_SQL = _oracle()
