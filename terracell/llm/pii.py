"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Strict patterns give the base spans. Looser generators propose further spans, overlapping ones included;
boosted trees over format and context features score them, and a threshold for each kind decides which are
added. All texts teach the trees and calibrate the thresholds, each by trees that did not see it. Everything that touches texts is a Column
expression on its own row: no shuffle, no Python on the executors. The driver sees one counter for each
combination of features (a bounded table, see FEATURES) and boosts on that.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import carried

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Possessive loops and \G or look-behind starts find the same matches as the plain forms,
# without recursion on long runs and without a second look at the same run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]{1,63}){0,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3,5}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9][\x20./_-]?){12,18}[0-9](?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
CONTEXT = {
    "email": "mail|contact|write to|e-mail|from:|to:",
    "ip": "ip|host|server|address|addr|ping|from",
    "card": "card|visa|master|amex|credit|debit|carte|karte|tarjeta|payment|account",
    "phone": "phone|tel|call|mobile|fax|cell|dial|whatsapp|sms|anruf|móvil",
}
OTHER_CONTEXT = "token|key|secret|hash|sha|md5|version|order|invoice|isbn|serial|ref|\\bid|\\bno\\.|nr\\."
#: Features and how many values each can take; what is known of a candidate is one of 2*3*3*6*5*2 combinations a kind.
FEATURES = {"after": 2, "edge": 3, "words": 3, "size": 6, "shape": 5, "check": 2}


#: Items that one aggregate runs over, in prefixes of long arrays.
BLOCK = 64
#: Code points of a block of a text that is cut in many places.
TEXT_BLOCK = 1000
#: Candidates, by start, that may lie between two that touch: patterns bound their lengths (450 at most, 3 at least).
NEIGHBOURS = 300


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body looks at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def smaller(x: Column, y: Column) -> Column:
    return F.least(x, y)


def before_each(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each of an array of ints, zero merged with all before it.

    Totals of blocks come first, so the work grows like the array's length (and its square only over
    BLOCK ** 2), where a single aggregate would copy its result for each item.
    """
    none = F.array().cast("array<int>")

    def run(v: Column) -> Column:
        count = F.ceil(F.size(v) / BLOCK).cast("int")
        totals = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), zero, merge))
        starts = F.aggregate(totals, F.struct(zero.alias("at"), none.alias("out")), lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return bound(starts, lambda b: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.element_at(b, ((i - i % BLOCK) / BLOCK).cast("int") + 1), merge)))

    return F.when(F.size(values) > 0, bound(values, run)).otherwise(none)


def located(rows: DataFrame, patterns: dict[str, str], needs: dict[str, str], prefix: str) -> DataFrame:
    """rows with {prefix}{kind} for each pattern: an array of (start, stop, value, before, after), its matches in _t.

    Positions count code points: the pieces between matches, in turn with the matches, give them. before and
    after: text around a match up to the next one. needs: a condition without which there is no match, to
    skip the search.
    """
    quoted = {k: "r'" + p.replace("'", "\\'") + "'" for k, p in patterns.items()}
    rows = rows.withColumns({f"_f_{k}": F.expr(f"case when {needs[k]} then regexp_extract_all(_t, {q}, 0) end") for k, q in quoted.items()})
    rows = rows.withColumns({f"_g_{k}": F.expr(f"case when size(_f_{k}) > 0 then split(_t, {q}, -1) end") for k, q in quoted.items()})
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,value:string,before:string,after:string>>)")

    def matches(k: str) -> Column:
        found, gaps = F.col(f"_f_{k}"), F.col(f"_g_{k}")
        item = lambda x, i: F.element_at(x, i)
        numbers = F.sequence(F.lit(1), F.size(found))

        def placed(at: Column) -> Column:
            start = lambda i: item(at, i) + F.length(item(gaps, i))
            return F.transform(numbers, lambda i: F.struct(start(i).alias("start"), (start(i) + F.length(item(found, i))).alias("stop"), item(found, i).alias("value"), F.right(item(gaps, i), F.lit(24)).alias("before"), F.left(item(gaps, i + 1), F.lit(1)).alias("after")))

        lengths = F.transform(numbers, lambda i: F.length(item(gaps, i)) + F.length(item(found, i)))
        return F.when(F.size(found) > 0, bound(before_each(lengths, lambda x, y: x + y, F.lit(0)), placed)).otherwise(empty)

    return rows.withColumns({f"{prefix}{k}": matches(k) for k in patterns}).drop(*[f"_{x}_{k}" for k in patterns for x in "fg"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 19 digits passes Luhn's check."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(n.between(1, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def octets_fit(value: Column) -> Column:
    return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))*$")


def passes(kind: str, value: Column) -> Column:
    """The check that a base match of a kind must pass."""
    if kind == "ip":
        return octets_fit(value)
    if kind == "card":
        return F.when(F.length(digits(value)).between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def features(kind: str, c: Column) -> dict[str, Column]:
    """Format and context of a candidate, in bins. What only tells the strict form apart (a leading +, the
    separator, an obfuscated @) is left out, so that the same thing in another form scores alike."""
    v, d = c["value"], digits(c["value"])
    before, last = F.lower(c["before"]), F.right(c["before"], F.lit(1))
    n = F.length(d)
    size = {
        "email": F.least(F.length(F.regexp_extract(v, r"^[A-Za-z0-9._%+-]+", 0)) / 4, F.lit(5)),
        "ip": F.least(n / 3, F.lit(5)),
        "card": F.least(F.greatest(n - 13, F.lit(0)), F.lit(5)),
        "phone": F.least(F.greatest(n - 7, F.lit(0)), F.lit(5)),
    }[kind]
    parts = F.size(F.split(v, r"[\x20./_()@\[\]{}-]+", -1))
    check = {
        "email": v.rlike(r"(?:\.|dot|DOT)[\])}\x20]*[A-Za-z]{2,}$"),
        "ip": octets_fit(v),
        "card": F.when(n.between(14, 19), luhn(d)).otherwise(False),
        "phone": v.rlike(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"),
    }[kind]
    return {
        "after": c["after"].rlike(r"[A-Za-z0-9_]").cast("int"),
        "edge": F.when(last.rlike(r"[A-Za-z0-9_.]"), 1).when(last.rlike("[=#$€\"'/:]"), 2).otherwise(0),
        "words": F.when(before.rlike(OTHER_CONTEXT), 2).when(before.rlike(CONTEXT[kind]), 1).otherwise(0),
        "size": size.cast("int"),
        "shape": F.least(parts - 1, F.lit(4)).cast("int"),
        "check": check.cast("int"),
    }


@dataclass(frozen=True)
class Tree:
    """A node: feature <= at goes left. A leaf has value only."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, row: dict[str, int]) -> float:
        return self.value if not self.feature else (self.left if row[self.feature] <= self.at else self.right).of(row)

    def column(self, c: Column) -> Column:
        return F.lit(self.value) if not self.feature else F.when(c[self.feature] <= self.at, self.left.column(c)).otherwise(self.right.column(c))


@dataclass(frozen=True)
class Model:
    """Trees and a threshold on their sum for each kind; no threshold: nothing of the kind is added."""

    trees: dict[str, list[Tree]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)


def _grow(rows: list[tuple[dict[str, int], float, float]], depth: int, shrink: float) -> Tree:
    """A tree on (features, gradient, hessian), by the gain of second-order boosting."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf, best = Tree(value=shrink * g / (h + 1.0)), (1e-6, None, 0)
    if depth:
        for f, n in FEATURES.items():
            for at in range(n - 1):
                gl = sum(r[1] for r in rows if r[0][f] <= at)
                hl = sum(r[2] for r in rows if r[0][f] <= at)
                gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
                best = max(best, (gain, f, at), key=lambda x: x[0])
    if best[1] is None:
        return leaf
    _, f, at = best
    return Tree(0.0, f, at, _grow([r for r in rows if r[0][f] <= at], depth - 1, shrink), _grow([r for r in rows if r[0][f] > at], depth - 1, shrink))


def _trees(train: list[tuple[dict[str, int], int, int]], rounds: int, depth: int, shrink: float) -> list[Tree]:
    """Trees boosted on (features, label, count); rows alike in the first two are taken together."""
    alike: dict[tuple, int] = {}
    for f, label, n in train:
        key = (tuple(f[x] for x in FEATURES), label)
        alike[key] = alike.get(key, 0) + n
    own = [(dict(zip(FEATURES, values)), label, n) for (values, label), n in alike.items()]
    trees: list[Tree] = []
    scores = [0.0] * len(own)
    for _ in range(rounds):
        rows = []
        for (f, label, n), score in zip(own, scores):
            p = 1 / (1 + math.exp(-score))
            rows.append((f, n * (label - p), n * p * (1 - p)))
        trees.append(_grow(rows, depth, shrink))
        scores = [score + trees[-1].of(f) for (f, _, _), score in zip(own, scores)]
    return trees


def _scored(trees: list[Tree], rows: list[tuple[dict[str, int], int, int]]) -> list[tuple[float, int, int]]:
    """(score, label, count) of (features, label, count)."""
    return [(sum(t.of(f) for t in trees), label, n) for f, label, n in rows]


def boosted(counts: list[tuple[str, dict[str, int], int, int, int]], rounds: int = 12, depth: int = 3, shrink: float = 0.4, precision: float = 0.9) -> Model:
    """Trees and thresholds from (kind, features, label, fold, count). Fold 0 calibrates, the others train.

    The threshold of a kind is the lowest score from which candidates of the calibration fold are positives
    with the given precision, smoothed by one positive and one negative more.
    """
    model = Model()
    for kind in KINDS:
        own = [x for x in counts if x[0] == kind]
        train, test = [(f, label, n) for _, f, label, fold, n in own if fold], [(f, label, n) for _, f, label, fold, n in own if not fold]
        if not any(x[1] for x in train) or not test:
            continue
        trees = _trees(train, rounds, depth, shrink)
        scored = sorted(_scored(trees, test), key=lambda x: (-x[0], x[1]))
        good = seen = 0
        for k, (score, label, n) in enumerate(scored):
            good, seen = good + label * n, seen + n
            last = k + 1 == len(scored) or scored[k + 1][0] < score
            if last and good + 1 >= precision * (seen + 2):
                model.thresholds[kind] = score - 1e-9
        model.trees[kind] = trees
    return model


def cross_boosted(counts: list[tuple[str, dict[str, int], int, int, int]], rounds: int = 12, depth: int = 3, shrink: float = 0.4, precision: float = 0.9) -> Model:
    """Trees and thresholds from (kind, features, label, fold, count), both from all folds.

    The trees learn from every count. For the threshold, each fold is scored by trees of the other folds, so that
    every count calibrates and none by trees that saw it. It is the lowest of the trees' scores from which the
    candidates are positives with the given precision, smoothed by one positive and one negative more; the folds'
    trees differ a little, so their scores are cut halfway to the next lower score of the trees.
    """
    model = Model()
    for kind in KINDS:
        own = [x for x in counts if x[0] == kind]
        folds = sorted({x[3] for x in own})
        if len(folds) < 2 or not any(x[2] for x in own):
            continue
        rows = {k: [(f, label, n) for _, f, label, fold, n in own if fold == k] for k in folds}
        trees = _trees([x for k in folds for x in rows[k]], rounds, depth, shrink)
        unseen = []
        for k in folds:
            unseen += _scored(_trees([x for j in folds if j != k for x in rows[j]], rounds, depth, shrink), rows[k])
        levels = sorted({score for k in folds for score, _, _ in _scored(trees, rows[k])}, reverse=True)
        for score, lower in zip(levels, [*levels[1:], -math.inf]):
            reached = [(label, n) for x, label, n in unseen if x >= (score + lower) / 2]
            if sum(label * n for label, n in reached) + 1 >= precision * (sum(n for _, n in reached) + 2):
                model.thresholds[kind] = score - 1e-9
        model.trees[kind] = trees
    return model


def _span(kind: str, m: Column) -> list[Column]:
    return [m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["stop"].alias("stop")]


def _valid(kind: str) -> Column:
    return F.transform(F.filter(f"_m_{kind}", lambda m: passes(kind, m["value"])), lambda m: F.struct(*_span(kind, m)))


def _described(kind: str) -> Column:
    return F.transform(f"_c_{kind}", lambda c: F.struct(*_span(kind, c), *[x.alias(n) for n, x in features(kind, c).items()]))


_TOUCHED = "array<struct<start:int,kind:int,stop:int," + ",".join(f"{f}:int" for f in FEATURES) + ",touched:int>>"


def _beside_base() -> Column:
    """_cand with touched: bits of the kinds of base spans that a candidate touches.

    Base spans and candidates in one order, by start: a candidate is touched by a span before it if the furthest end
    of these lies behind its start, and by one after it if the next of these starts before its end.
    """
    base = F.transform("_base", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("t"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.lit(None).cast("int").alias("place")))
    cand = F.transform("_cand", lambda x, i: F.struct(x["start"].alias("start"), F.lit(1).alias("t"), x["kind"].alias("kind"), x["stop"].alias("stop"), i.alias("place")))
    last = (1 << 31) - 1

    def marked(items: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(items))

        def bits(kind: int) -> Column:
            own = lambda x: (x["t"] == 0) & (x["kind"] == kind)
            ends = before_each(F.transform(items, lambda x: F.when(own(x), x["stop"]).otherwise(-1)), larger, F.lit(-1))
            starts = F.reverse(before_each(F.reverse(F.transform(items, lambda x: F.when(own(x), x["start"]).otherwise(last))), smaller, F.lit(last)))
            return F.when(F.exists("_base", lambda x: x["kind"] == kind), bound(F.struct(ends.alias("e"), starts.alias("s")), lambda p: F.transform(numbers, lambda i: ((F.element_at(p["e"], i) > F.element_at(items, i)["start"]) | (F.element_at(p["s"], i) < F.element_at(items, i)["stop"])).cast("int") * (1 << kind)))).otherwise(F.transform(numbers, lambda i: F.lit(0)))

        sums = F.zip_with(F.zip_with(bits(0), bits(1), lambda x, y: x + y), F.zip_with(bits(2), bits(3), lambda x, y: x + y), lambda x, y: x + y)
        return F.array_sort(F.filter(F.zip_with(items, sums, lambda x, b: F.struct(x["place"].alias("place"), b.alias("touched"))), lambda x: x["place"].isNotNull()))

    none = F.transform("_cand", lambda c: F.lit(0))
    touched = F.when(F.size("_base") > 0, F.transform(bound(F.array_sort(F.concat(base, cand)), marked), lambda x: x["touched"])).otherwise(none)
    return F.zip_with("_cand", touched, lambda c, t: F.struct(*[c[n].alias(n) for n in ("start", "kind", "stop", *FEATURES)], t.alias("touched")))


def with_spans(docs: DataFrame, text: str = "text", candidates: bool = True) -> DataFrame:
    """docs with _t (text, null as empty), _base (base spans by start, then kind) and _cand (candidates by start, with features and touched)."""
    needs = {"email": "contains(_t, '@')", "ip": "_dots", "card": "_digits", "phone": "contains(_t, '+')"}
    loose = {"email": r"(contains(_t, '@') or _t rlike r'[\[({](?:at|AT)[\])}]')", "ip": "_dots", "card": "_digits", "phone": "_digits"}
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_digits", F.col("_t").rlike("[0-9]")).withColumn("_dots", F.col("_digits") & F.col("_t").rlike(r"[0-9]\.[0-9]"))
    rows = located(rows, BASE, needs, "_m_")
    ok = [_valid(k) for k in KINDS]
    rows = rows.withColumn("_base", F.array_sort(F.concat(*ok))).drop(*[f"_m_{k}" for k in KINDS])
    if candidates:
        rows = located(rows, CANDIDATES, loose, "_c_")
        rows = rows.withColumn("_cand", F.array_sort(F.concat(*[_described(k) for k in KINDS]))).drop(*[f"_c_{k}" for k in KINDS])
        rows = rows.withColumn("_cand", F.when(F.size("_cand") > 0, _beside_base()).otherwise(F.expr("cast(array() as " + _TOUCHED + ")")))
    return rows.drop("_digits", "_dots")


def labelled(c: Column) -> Column:
    """1, 0 or null for a candidate beside _base.

    Positive: it overlaps a base span of its kind (features don't show the strict form, so this is the
    look-alike without it), or words of its kind stand before it, its check passes and no letter follows.
    Negative: words of something else stand before it, a letter or digit follows, or a check fails that every
    item of the kind passes (not the phone's, which is one national form). Anything else, and what overlaps a
    base span of another kind, says nothing: loose forms without evidence are not learned as negatives.
    """
    own: Column = F.lit(1)
    for k in range(1, len(KINDS)):
        own = F.when(c["kind"] == k, 1 << k).otherwise(own)
    sure = (c["words"] == 1) & (c["check"] == 1) & (c["after"] == 0)
    wrong = (c["words"] == 2) | (c["after"] == 1) | ((c["check"] == 0) & (c["kind"] != KINDS.index("phone")))
    return F.when(c["touched"].bitwiseAND(own) != 0, 1).when(c["touched"] != 0, None).when(wrong, 0).when(sure, 1)


def fitted(docs: DataFrame, text: str = "text", folds: int = 4, **options) -> Model:
    """The model of docs, from candidates with evidence beside the strict form; see labelled() and cross_boosted().

    Trees and thresholds come from all documents; the driver gets at most one row for a kind, combination of
    features, label and fold. A document's fold is a hash of its text.
    """
    rows = with_spans(docs.select(text), text)
    flat = rows.select(F.pmod(F.xxhash64("_t"), F.lit(folds)).cast("int").alias("fold"), F.explode(F.transform("_cand", lambda c: F.struct(c["kind"].alias("kind"), *[c[f].alias(f) for f in FEATURES], labelled(c).alias("label")))).alias("c")).select("fold", "c.*").where("label is not null")
    counts = flat.groupBy("kind", *FEATURES, "label", "fold").count().collect()
    return cross_boosted([(KINDS[r["kind"]], {f: r[f] for f in FEATURES}, r["label"], r["fold"], r["count"]) for r in sorted(counts)], **options)


def found(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of struct(start, kind, stop), by start, then kind (a position in KINDS).

    Positions count code points, the end is exclusive. spans has every base span, and candidates at or over
    their kind's threshold that touch no base span and no candidate of a higher score (ties: the one that
    starts first, then of the kind listed first). Null and empty texts have no spans. Repeated rows and other columns stay.
    """
    model = fitted(docs, text) if model is None else model
    some = [k for k in KINDS if k in model.thresholds]
    rows = with_spans(docs, text, bool(some))
    if not some:
        return rows.withColumnRenamed("_base", "base_spans").withColumn("spans", F.col("base_spans")).drop("_t")

    def score(c: Column) -> Column:
        total = F.lit(None).cast("double")
        for k in some:
            trees = [t.column(c) for t in model.trees[k]]
            total = F.when(c["kind"] == KINDS.index(k), sum(trees[1:], trees[0]) - F.lit(model.thresholds[k])).otherwise(total)
        return total

    scored = F.transform("_cand", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["touched"].alias("touched"), score(c).alias("score")))
    rows = rows.withColumn("_scored", F.filter(scored, lambda c: (c["score"] >= 0) & (c["touched"] == 0)))

    def best(items: Column) -> Column:
        """Those of items that touch none of a higher score; only neighbours by start can touch."""
        order = lambda c: F.struct(c["score"], -c["start"], -c["kind"])
        near = lambda i: F.slice(items, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        return F.filter(items, lambda c, i: ~F.exists(near(i), lambda o: (o["start"] < c["stop"]) & (c["start"] < o["stop"]) & (order(o) > order(c))))

    kept = F.when(F.size("_scored") > 1, bound(F.col("_scored"), best)).otherwise(F.col("_scored"))
    rows = rows.withColumn("_add", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))))
    return rows.withColumn("spans", F.array_sort(F.concat("_base", "_add"))).withColumnRenamed("_base", "base_spans").drop("_t", "_cand", "_scored", "_add")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first is named and all are cut.

    n_chars, where docs has it, becomes the new length. Null texts stay null.
    """
    rows = found(carried(docs, F.col(text).alias("text")), fitted(docs, text) if model is None else model)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The text from code point a to b, from its blocks."""
        of = lambda x: ((x - x % TEXT_BLOCK) / TEXT_BLOCK).cast("int")
        block = lambda k: F.coalesce(F.try_element_at(blocks, k + 1), F.lit(""))
        same = F.substring(block(of(a)), a % TEXT_BLOCK + 1, b - a)
        apart = F.concat(F.substring(block(of(a)), a % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, of(a) + 2, of(b) - of(a) - 1), ""), F.substring(block(of(b)), F.lit(1), b % TEXT_BLOCK))
        return F.when(of(a) == of(b), same).otherwise(apart)

    def parts(ends: Column) -> Column:
        """Pieces of text in front of spans with their tags, none for spans that start inside of another; and the rest."""
        blocks = F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))
        spans, last = F.col("spans"), F.array_max(F.transform("spans", lambda x: x["stop"]))
        piece = lambda b, x, e: F.when(x["start"] >= e, F.concat(between(b, e, x["start"]), F.element_at(tags, x["kind"] + 1))).otherwise("")
        return bound(blocks, lambda b: F.concat(F.array_join(F.zip_with(spans, ends, lambda x, e: piece(b, x, e)), ""), between(b, last, F.length("text"))))

    cut = bound(before_each(F.transform("spans", lambda x: x["stop"]), larger, F.lit(0)), parts)
    rows = rows.withColumn("_new", F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))
    fresh = {text: F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return rows.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
