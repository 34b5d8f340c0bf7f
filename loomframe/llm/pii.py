"""Operator 3: personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans: e-mail addresses plain and spelt out, dotted numbers, digit runs, phone
numbers with and without a country code, dotted numbers in brackets, and secrets after a key word. Spans of the
base rules (see BASE) always stay. Other candidates of the generators in SCORED get features of their format
(length, digits, separators, checksum, distinct characters) and of its context (characters and key words around it); boosted trees score it, a logistic
calibration turns the score into a probability, and a threshold per generator selects the spans to add.

Trees are fitted in the driver on examples that `training_examples` writes from rules with a fixed seed (they
hold no row of any table), their features computed by the same expressions, and compiled into conditional
expressions. The tables have no labels for personal data, so what the trees know is what those rules say. On
executors there is no Python and no shuffle: a row is split at the matches of each pattern, and positions are sums
of the lengths of pieces, taken by lots; what functions of elements read is a column or zipped with the elements,
never an expression that each would compute anew, so the work is about linear in the matches.

Patterns are written so that Java's matcher neither recurses nor rescans a run: repetition of groups is
possessive where no match needs to give back, and a match begins at the start of a run or where the last ended.

Defined results: a null or empty text has no spans; a very long text is searched whole, in memory of some times
its size; an empty table gives no rows; candidates of one place and kind are each listed once for each generator
that proposes them, base ones first; repeated rows are each searched; other columns are not read unless redact()
carries them, which replaces the text alone and takes names for its own columns that df has not. Spans may
overlap; redact() joins those that do, as the kind of the first.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.textcut import free_name, replaced, running

#: Kinds in their order, the base four first.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
_LOCAL = r"[A-Za-z0-9._%+-]"
_HOST = r"[A-Za-z0-9-]"
#: Generator: kind, pattern, and a pattern that is found wherever that one is but fails at once at most characters (a cheap test before the search).
GENERATORS: list[tuple[str, str, str]] = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[\[(]at[\])] ?{_HOST}{{1,64}}+(?: ?[\[(]dot[\])] ?{_HOST}{{1,32}}+){{1,4}}", r"[\[(]at[\])]"),
    ("phone", r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9][\x20.-][0-9]{4}"),
    ("secret", r"(?i:passw(?:or)?d|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,256}[\"']?", r"[=:](?<=(?i:passw(?:or)?d|pwd|token|secret|api[_-]?key)\s{0,3}[=:])"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", r"A[KS]IA[A-Z0-9]{16}"),
    ("ip", r"(?<![0-9])[0-9]{1,4}+(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,4}+){3}+", r"[0-9] ?[\[(](?:\.|dot)[\])] ?[0-9]"),
]
#: Generators whose candidates beyond the base rules can be right; of the others only base spans are taken.
SCORED = [2, 3, 4, 5, 6, 7, 8]
CONTEXT = 32
FEATURES = ["generator", "length", "digits", "marks", "upper", "lower", "distinct", "luhn", "groups", "longest", "largest", "before", "after", "hint", "against"]
HINTS = r"(?i)phone|tel|call|mobile|fax|mail|contact|card|visa|credit|payment|password|login|token|secret|key|address|host"
AGAINST = r"(?i)version|isbn|issn|order|invoice|serial|part|page|date|doi|figure|table|[0-9+][\x20().-]*$"


# -- spans -----------------------------------------------------------------------------------------------------


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_base(generator: int, m: Column) -> Column:
    if generator == 0:
        return F.lit(True)
    if generator == 1:
        octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if generator == 2:
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if generator == 3:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(False)


def _features(generator: Column, m: Column, before: Column, after: Column) -> list[Column]:
    left = lambda pattern: F.length(F.regexp_replace(m, pattern, ""))
    edge = lambda c: F.when(c.rlike("[A-Za-z]"), 1.0).when(c.rlike("[0-9]"), 2.0).when(c.rlike(r"\S"), 3.0).otherwise(0.0)
    groups = F.split(m, "[^A-Za-z0-9]+")
    out = [
        generator, F.length(m), left("[^0-9]"), left("[A-Za-z0-9]"), left("[^A-Z]"), left("[^a-z]"), F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), ""))),
        F.call_function("luhn_check", _digits(m)).cast("double"), F.size(groups), F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g))),
        F.aggregate(groups, F.lit(0.0).cast("double"), lambda a, g: F.when(g.rlike("^[0-9]{1,4}$"), F.greatest(a, g.cast("double"))).otherwise(a)),
        edge(F.right(before, F.lit(1))), edge(F.left(after, F.lit(1))), before.rlike(HINTS).cast("double"), before.rlike(AGAINST).cast("double"),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in out]


def _candidates(text: Column, generator: int) -> Column:
    """Matches of a generator, and the pieces of text around them."""
    _, pattern, needs = GENERATORS[generator]
    cheap = text.rlike(needs)
    pieces = F.when(cheap, F.split(text, pattern, -1)).otherwise(F.array(text))
    matches = F.when(cheap, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.struct(pieces.alias("pieces"), matches.alias("matches"))


def _sizes(found: Column) -> Column:
    """Characters of each match and of the piece before it. An array named in a function of elements would be made anew for each, so all are zipped."""
    return F.transform(F.arrays_zip(F.slice(found["pieces"], 1, F.size(found["matches"])).alias("piece"), found["matches"].alias("m")), lambda z: (F.length(z["piece"]) + F.length(z["m"])).cast("long"))


def _spans(found: Column, sizes: Column, generator: int) -> Column:
    """Of each match: kind, start, end (code points), if a base rule takes it, the match, and what is around it."""
    pieces, matches = found["pieces"], found["matches"]
    n = F.size(matches)
    zipped = F.arrays_zip(matches.alias("m"), running(sizes, lambda a, n: a + n).alias("begin"), sizes.alias("size"), F.slice(pieces, 1, n).alias("left"), F.slice(pieces, 2, n).alias("right"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.lit(KINDS.index(GENERATORS[generator][0])).alias("kind"),
            (z["begin"] + F.length(z["left"])).cast("long").alias("start"),
            (z["begin"] + z["size"]).cast("long").alias("end"),
            _is_base(generator, z["m"]).alias("base"),
            F.lit(generator).alias("generator"),
            z["m"].alias("m"),
            F.right(z["left"], F.lit(CONTEXT)).alias("before"),
            F.left(z["right"], F.lit(CONTEXT)).alias("after"),
        ),
    )


# -- boosted trees ----------------------------------------------------------------------------------------------


def training_examples(seed: int = 7, each: int = 160) -> list[tuple[int, str, str, str, int]]:
    """(generator, match, before, after, label), written from rules: candidates that no base rule takes, as only those are scored."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    code = lambda n, of="0123456789abcdef": "".join(r.choice(of) for _ in range(n))
    prose = lambda: f"{word()} {word()} {r.choice(['in', 'of', 'and', word()])} "
    ask = lambda *keys: f"{word()} {r.choice(keys)}{r.choice([': ', ' ', ' is '])}"
    near = lambda: r.choice([prose(), f"{word()} {digits(r.randint(1, 4))} ", f"{word()}: "])
    out = []
    for _ in range(each):
        tail = r.choice([" ", ". ", ", "]) + word()
        host = f"{word()}{r.choice(['(dot)', ' [dot] '])}{r.choice(['com', 'org', 'net'])}"
        wrong, mark = r.randrange(4), r.choice(["[.]", "(.)", " [.] ", "[dot]", " (dot) "])
        out += [
            (8, mark.join(str(r.randint(0, 255)) for _ in range(4)), r.choice([near(), ask("host", "address", "server", word())]), tail, 1),
            (8, mark.join(str(r.randint(256, 2024) if k == wrong else r.randint(0, 300)) for k in range(4)), r.choice([near(), ask("version", "section", "page", word())]), tail, 0),
            (2, " ".join([digits(4)] * 3 + [digits(4)]), ask("card", "visa", "credit card"), tail, 1),
            (2, digits(r.randint(1, 12)), prose(), tail, 0),
            (2, digits(r.randint(13, 24)), r.choice([prose(), ask("order", "serial", "invoice", "isbn")]), tail, 0),
            (2, f"{r.randint(1900, 2100)}-{digits(2)}-{digits(2)} {digits(2)}", ask("date", word()), tail, 0),
            (3, f"+{digits(r.randint(1, 2))}{r.choice(' -')}{digits(3)}{r.choice(' -.')}{digits(r.randint(3, 4))}"[:11], ask("call", "phone", "tel", "mobile", "fax"), tail, 1),
            (3, f"+{digits(r.randint(2, 8))}", r.choice([prose(), ask("version", "table", "about")]), tail, 0),
            (3, f"+{digits(1)}{r.choice('. ')}{digits(r.randint(2, 5))}", r.choice([prose(), f"{word()} {digits(2)}"]), tail, 0),
            (3, f"+{digits(r.randint(16, 30))}", prose(), tail, 0),
            (4, f"{word()}{r.choice(['(at)', ' [at] '])}{host}", r.choice([near(), ask("mail", "contact")]), tail, 1),
            (4, f"{word(1, 2)} (at){word(1, 2)}(dot){word(9, 12)}", ask("table", "figure"), tail, 0),
            (5, f"({digits(3)}) {digits(3)}-{digits(4)}", r.choice([prose(), ask("call", "phone", "tel")]), tail, 1),
            (5, f"{digits(3)}{(s := r.choice('-. '))}{digits(3)}{s}{digits(4)}", ask("call", "phone", "fax", "mobile"), tail, 1),
            (5, f"{digits(3)}{r.choice('-. ')}{digits(3)}{r.choice('-. ')}{digits(4)}", r.choice([ask("order", "isbn", "part"), f"{word()} +{digits(1)} ", f"{word()} {digits(2)} "]), tail, 0),
            (6, f"{r.choice(['password', 'pwd', 'passwd'])}={code(r.randint(8, 24))}", near(), tail, 1),
            (6, f'{r.choice(["token", "secret", "api_key"])} = "{code(r.choice([20, 32, 40]))}"', near(), tail, 1),
            (6, f"{r.choice(['password', 'token', 'secret'])}: {word(6, 12)}", near(), tail, 0),
            (6, f"{r.choice(['token', 'secret'])} = {word(6, 12)}", near(), tail, 0),
            (7, f"AKIA{code(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", near(), tail, 1),
            (7, f"A{r.choice(['KIA', 'SIA'])}{r.choice('ABCDEF') * 16}", near(), tail, 0),
        ]
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> list:
    """Gradient boosting of logistic loss: each tree a nested (feature, cut, low, high), leaves numbers."""

    def grow(rows: np.ndarray, level: int):
        g, h = grad[rows], hess[rows]
        leaf = rate * g.sum() / (h.sum() + 1.0)
        if level == depth or len(rows) < 2 * least:
            return float(leaf)
        whole, best = g.sum() ** 2 / (h.sum() + 1), (1e-6, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[:-1] + values[1:]) / 2 if len(values) < 40 else np.quantile(values, np.linspace(0.03, 0.97, 32)):
                low = x[rows, f] <= cut
                if least <= low.sum() <= len(rows) - least:
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is None:
            return float(leaf)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], level + 1), grow(rows[~low], level + 1))

    out, score = [], np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        tree = grow(np.arange(len(x)), 0)
        out.append(tree)
        score += apply_tree(tree, x)
    return out


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, apply_tree(low, x), apply_tree(high, x))


def _tree_column(tree, feature) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(feature(f) <= cut, _tree_column(low, feature)).otherwise(_tree_column(high, feature))


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from score to probability (Platt, with smoothed targets)."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, a, b = np.where(y == 1, up, down), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((t - p) * score).sum() - 1e-3 * a, (t - p).sum()
        haa, hab, hbb = (w * score * score).sum() + 1e-3, (w * score).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a + 0.5 * (hbb * ga - hab * gb) / det, b + 0.5 * (haa * gb - hab * ga) / det
    return float(a), float(b)


class Model:
    """Trees, calibration and a threshold for each generator: the least probability at which PRECISION holds on examples apart from training."""

    PRECISION = 0.98

    def __init__(self, spark: SparkSession):
        examples = training_examples()
        rows = spark.createDataFrame([(i, *e) for i, e in enumerate(examples)], "i int, generator int, m string, before string, after string, label int")
        feats = F.array(*_features(F.col("generator"), F.col("m"), F.col("before"), F.col("after")))
        got = sorted(rows.select("i", feats.alias("f")).collect())
        x, y = np.array([r["f"] for r in got]), np.array([e[-1] for e in examples], float)
        # trees, calibration and thresholds each see examples of their own
        part = np.random.default_rng(1).choice(3, len(y), p=[0.6, 0.2, 0.2])
        self.trees = fit_trees(x[part == 0], y[part == 0])
        score = sum(apply_tree(t, x) for t in self.trees)
        self.slope, self.intercept = calibrate(score[part == 1], y[part == 1])
        p = 1 / (1 + np.exp(-(self.slope * score + self.intercept)))
        self.thresholds = {}
        for g in SCORED:
            mine = (part == 2) & (x[:, 0] == g)
            cuts = [c for c in np.unique(p[mine]) if y[mine & (p >= c)].mean() >= self.PRECISION]
            self.thresholds[g] = max(0.5, float(cuts[0])) if cuts else 1.0
        self.accuracy = float(((p >= 0.5) == (y == 1))[part == 2].mean())

    def probability(self, feature) -> Column:
        score = F.lit(0.0)
        for t in self.trees:
            score = score + _tree_column(t, feature)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * self.slope + self.intercept)))


@lru_cache(maxsize=1)
def _model(app: str) -> Model:
    return Model(SparkSession.getActiveSession())


def model(spark: SparkSession) -> Model:
    return _model(spark.sparkContext.applicationId)


def find_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """df with an array of (kind, start, end, base), kind as a place in KINDS: base spans and those that the trees add, by kind and start."""
    trees = model(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, own = range(len(GENERATORS)), free_name(df, "__pii")
    # one projection for each use of what came before, so that no pattern is searched twice
    step = df.withColumns({f"{own}{g}": _candidates(text, g) for g in n})
    step = step.withColumns({f"{own}s{g}": _sizes(F.col(f"{own}{g}")) for g in n})
    step = step.withColumns({f"{own}{g}": _spans(F.col(f"{own}{g}"), F.col(f"{own}s{g}"), g) for g in n}).drop(*[f"{own}s{g}" for g in n])
    # base spans of all generators and other candidates apart, so that only the latter are scored
    step = step.withColumn(own, F.concat(*[F.col(f"{own}{g}") for g in n])).drop(*[f"{own}{g}" for g in n])
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    rest = F.filter(own, lambda c: ~c["base"] & c["generator"].isin(SCORED))
    valued = F.transform(rest, lambda c: F.struct(plain(c).alias("span"), F.array(*_features(c["generator"], c["m"], c["before"], c["after"])).alias("f")))
    limit = F.array(*[F.lit(trees.thresholds.get(g, 1.0)) for g in n])
    added = F.filter(valued, lambda v: trees.probability(lambda i: F.element_at(v["f"], i + 1)) >= F.element_at(limit, F.element_at(v["f"], 1).cast("int") + 1))
    sure = F.transform(F.filter(own, lambda c: c["base"]), plain)
    return step.withColumn(out_col, F.array_sort(F.concat(sure, F.transform(added, lambda v: v["span"])))).drop(own)


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of base spans by kind, digest of the base spans, and all spans, of each row."""
    found = find_spans(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "spans")
    found = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{BASE[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of the text replaced by its kind in brackets; spans that overlap become one, of the first's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = free_name(df, "__spans")
    found = find_spans(df, text_col, spans)
    found = found.withColumn(spans, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return replaced(found, text_col, spans, lambda s: F.element_at(names, s["kind"] + 1))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
