"""Quality rules as noisy voters: each votes keep, reject or abstains; a label model weighs them.

One pass turns every whole text into a short row of figures. Votes are counted by pattern (at most 3 to the number of
rules), expectation-maximisation on those counts estimates how often each rule votes how for good and for bad
documents, and the posterior probability of each pattern decides. Only column expressions touch the texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import Workspace, let, table, words


@dataclass(frozen=True)
class Rule:
    """Votes reject where `bad` holds, keep where `good` holds, else abstains; both are SQL conditions on the figures."""

    name: str
    bad: str
    good: str


#: Ratios are per word or per character of words. Between the two limits of a rule it abstains.
RULES = (
    Rule("length", "n_words < 5", "n_words >= 50"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars"),
    Rule("exclamations", "4 * n_exclamations > n_words", "50 * n_exclamations <= n_words"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
)


def _repeat_words(w: Column, n: Column) -> Column:
    """How many words lie in 3-word windows that the text holds twice or more.

    Window hashes, with the position in their lowest bits, are sorted; equal neighbours are compared word by word.
    """
    room = F.pow(F.lit(2), F.ceil(F.log2(n + 1))).cast("long")
    same_words = lambda p, q: (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])

    def covered(args: Column) -> Column:
        m, s = args["m"], args["s"]
        at = lambda x: x.bitwiseAND(m - 1).cast("int")
        alike = lambda x, y: x.bitwiseXOR(y).between(F.lit(0), m - 1) & same_words(at(x), at(y))
        last = F.size(s) - 1
        again = F.filter(
            s, lambda x, j: F.when(j > 0, alike(x, s[F.greatest(j - 1, F.lit(0))])).otherwise(F.lit(False))
            | F.when(j < last, alike(x, s[F.least(j + 1, last)])).otherwise(F.lit(False)),
        )
        starts = F.array_sort(F.transform(again, at))
        return let(starts, lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, x: F.struct(
                (acc["n"] + x + 3 - F.greatest(acc["end"], x)).alias("n"), (x + 3).alias("end"),
            ), lambda acc: acc["n"],
        ))

    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(-room) + i,
    )
    made = F.struct(room.alias("m"), F.sort_array(packed).alias("s"))
    return F.when(n < 3, F.lit(0)).otherwise(let(made, covered)).cast("long")


def text_figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of whole numbers per document: the id (as _id) and what the rules look at."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w, F.size(w)).alias("n_repeat_words"),
    ))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select(
        "_id", by_words.alias("_w"), by_lines.alias("_l"), count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"), count("!").alias("n_exclamations"),
    ).select("_id", "_w.*", "_l.*", "n_symbols", "n_capitals", "n_exclamations")


def _vote(rule: Rule) -> Column:
    """0 reject, 1 abstain, 2 keep."""
    return F.when(F.expr(rule.bad), F.lit(0)).when(F.expr(rule.good), F.lit(2)).otherwise(F.lit(1))


def fit_label_model(counts: dict[tuple[int, ...], int], n_rules: int, *, rounds: int = 100, prior: float = 0.8):
    """Expectation-maximisation on vote patterns: what each rule votes on good documents and on each kind of junk.

    counts: documents per pattern. The hidden class of a document is good (0) or the kind of junk that rule j is about
    (j + 1), since junk of one kind draws votes of few rules. A rule is held to be no worse than guessing: it rejects
    at least half of its own kind and at most half of the good documents it votes on. Abstaining says nothing. Returns log shares of the classes and, per
    class and rule, log probabilities of the three votes.
    """
    kinds = n_rules + 1
    share = [prior] + [(1 - prior) / n_rules] * n_rules
    tables = [[(0.5, 1.0, 0.5)] * n_rules for _ in range(kinds)]
    of = {}
    for p in counts:
        n = p.count(0)
        of[p] = [0.1 if n else 1.0] + [0.9 / n if v == 0 else 0.0 for v in p]
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        mass = [sum(of[p][c] * n for p, n in counts.items()) for c in range(kinds)]
        share = [(m + (4 * prior if c == 0 else 1)) / (total + 4 * prior + n_rules) for c, m in enumerate(mass)]
        tables = []
        for c in range(kinds):
            row = []
            for j in range(n_rules):
                # Prior beliefs, as votes: good documents pass a rule, junk of a rule's own kind does not.
                seen = [0.1, 0.0, 10.0] if c == 0 else [5.0, 0.0, 0.1] if c == j + 1 else [0.1, 0.0, 0.1]
                for p, n in counts.items():
                    seen[p[j]] += of[p][c] * n
                reject = seen[0] / (seen[0] + seen[2])
                bounded = min(reject, 0.5) if c == 0 else max(reject, 0.5) if c == j + 1 else reject
                row.append((bounded, 1.0, 1 - bounded))
            tables.append(row)
        before, of = of, {}
        for p in counts:
            likely = [math.log(share[c]) + sum(math.log(tables[c][j][v]) for j, v in enumerate(p)) for c in range(kinds)]
            most = max(likely)
            weights = [math.exp(x - most) for x in likely]
            of[p] = [w / sum(weights) for w in weights]
        if max(abs(of[p][0] - before[p][0]) for p in counts) < 1e-9:
            break
    return [math.log(x / sum(share)) for x in share], [[tuple(map(math.log, v)) for v in row] for row in tables]


def judge_quality(
    docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: the id, the figures, p_good (posterior that the document is good) and passed (p_good >= least).

    NULL and empty texts have no words and all figures 0; they pass or fail as the model says of such rows. Repeated
    rows each get a row. Other columns of the input are not looked at; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "quality-rules")
    figures = work.write(text_figures(docs, id_col=id_col, text_col=text_col), "figures")
    votes = [_vote(r).alias(f"_v{j}") for j, r in enumerate(rules)]
    names = [f"_v{j}" for j in range(len(rules))]
    counted = figures.select(*votes).groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    counts = {tuple(r[n] for n in names): r["count"] for r in sorted(counted)}
    share, tables = fit_label_model(counts, len(rules))
    likely = []
    for c, row in enumerate(tables):
        value = F.lit(share[c])
        for j, logs in enumerate(row):
            v = F.col(f"_v{j}")
            value = value + F.when(v == 0, F.lit(logs[0])).when(v == 1, F.lit(logs[1])).otherwise(F.lit(logs[2]))
        likely.append(value.alias(f"_k{c}"))
    judged = figures.select("*", *votes).select("*", *likely)
    odds = sum((F.exp(F.col(f"_k{c}") - F.col("_k0")) for c in range(1, len(tables))), F.lit(0.0))
    drop = [*names, *(f"_k{c}" for c in range(len(tables)))]
    judged = judged.withColumn("p_good", 1 / (1 + odds)).drop(*drop)
    return judged.withColumn("passed", F.col("p_good") >= least).withColumnRenamed("_id", id_col)


def op7_quality_rules(spark, sf_dir):
    judged = judge_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("passed")).alias("kept"), "p_good",
    )
