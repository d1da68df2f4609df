"""PII: candidate generators, boosted trees over format and context features, calibrated thresholds.

Base spans (email, ip, card, phone) are matches of fixed patterns that pass a
check. On top, high-recall generators propose overlapping spans: loose
addresses, number groups, identifiers with letters and digits, and values
assigned to a word such as `password`. Each candidate gets numbers that
describe its format (lengths, shares of character classes, distinct
characters, check digits) and the words and signs around it.

Boosted trees (three splits each, one a level) are fitted to weak labels: a
candidate is positive if it overlaps a valid base span, has a published key
format or valid account check digits, or is assigned to a secret word. In every
second candidate the features that tell this are blanked, so that the trees
learn the look and the surroundings of such values too. They are fitted on all
candidates of one fold of documents, counted by what the trees can tell apart;
all of the other fold set the threshold: the lowest score, in thousandths, from
which on at least PRECISION of the candidates are positive. Sums are of whole
numbers, so they do not depend on the order of rows. Accepted candidates that
overlap no base span are added; base spans always stay. Values announced as digests (`sha256`,
`commit`) are no candidates.

DataFrame functions only; the patterns are written so that Java's matcher
neither recurses nor starts again inside a run that has already failed, and
the work on a text grows with its length and its matches, not their square.

Cases: a null text is empty; a text without candidates has no spans and the
hash of the empty string; positions are code points, ends exclusive; repeated
rows each get a row; without positive candidates nothing is added; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import let, saved, small_enough

#: Share of positives that the threshold must reach on the calibration fold.
PRECISION = 0.98
#: Trees, splits in a tree, learning rate, and borders a feature.
TREES, DEPTH, RATE, BORDERS = 40, 3, 0.3, 24
#: Rows of counted candidates up to which the driver adds up a level of a tree; beyond, Spark does.
FEW = 50_000
#: A probability is a whole number of these parts, a score one of thousandths.
PARTS, STEPS = 1 << 24, 1000

#: Kinds in the order of the result; the added kinds follow the base kinds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("address", "number", "secret", "assigned")

#: Words before a value that is secret, belongs to a person, or is a digest (fixed lists).
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api_key", "api-key", "apikey", "access_key", "private_key", "auth", "credential")
PERSON_WORDS = ("phone", "tel", "mobile", "fax", "call", "mail", "contact", "card", "account", "iban", "passport", "ssn", "social", "license", "tax")
DIGEST_WORDS = ("commit", "sha1", "sha-1", "sha256", "sha-256", "sha512", "md5", "digest", "checksum", "hash", "revision", "etag")
#: Published formats of access keys (fixed).
KEY_FORMATS = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
_ASSIGNED = r"(?i:" + "|".join(SECRET_WORDS) + r")[\"']?[ \t]*+(?::|=>?)[ \t]*+[\"']?"

#: Equivalent to the contract's patterns: possessive where nothing can be given back, and begun at a run's start or the last match's end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address": r"(?<![^\s<>\"'()\[\],;:@])[^\s<>\"'()\[\],;:@]++@[^\s<>\"'()\[\],;:@]++",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[ .()-]{0,2}+[0-9])++(?![A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{8,}+",
    "assigned": "(" + _ASSIGNED + r")([^\s\"'<>,;]++)",
}
#: What a text must have for a pattern to be tried.
NEEDS = {
    "email": "@", "address": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "number": "[0-9][ .()-]{0,2}[0-9]",
    "secret": "[A-Za-z_/+-][0-9]|[0-9][A-Za-z_/+-]", "assigned": _ASSIGNED,
}
#: Digits that a number group must have to be proposed.
LEAST_DIGITS = 7
_MARK, _OTHER = "\x01", "\x02"
#: Code points of text before and after a candidate, up to the next match of its kind, that its features look at.
SIDE = 24
#: Elements whose running sums are made at once.
BLOCK = 256


def running(values, op, zero) -> F.Column:
    """What op makes of all values before each; in blocks, so that no long array grows by one."""
    grow = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def placed(blocks):
        before = grow(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: op(v, o))))

    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: i * BLOCK + 1)
    blocks = let(values, lambda vs: F.transform(starts, lambda a: grow(F.slice(vs, a, F.lit(BLOCK)))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, placed))


def _pieces(text, kind: str) -> F.Column:
    """The text cut at the matches of a pattern: those are the odd elements."""
    plain = F.replace(text, F.lit(_MARK), F.lit(_OTHER))
    put = f"$1{_MARK}$2{_MARK}" if kind == "assigned" else f"{_MARK}$0{_MARK}"
    return F.split(F.regexp_replace(plain, PATTERNS[kind], put), _MARK)


_SPAN = "kind:string,start:int,stop:int,s:string"


def _matches(text, kind: str, sides: bool = False) -> F.Column:
    """array<struct<kind, start, stop, s>> of the leftmost matches that don't overlap; with before and after if asked for."""

    def placed(pieces):
        def at(starts):
            def match(s, i):
                start = F.get(starts, i)
                more = (F.right(F.get(pieces, i - 1), F.lit(SIDE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(SIDE)).alias("after")) if sides else ()
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s)).alias("stop"), s.alias("s"), *more)

            return F.filter(F.transform(pieces, match), lambda x, i: i % 2 == 1)

        return let(running(F.transform(pieces, lambda s: F.length(s)), lambda a, b: a + b, F.lit(0)), at)

    none = F.array().cast(f"array<struct<{_SPAN}{',before:string,after:string' if sides else ''}>>")
    return F.when(text.rlike(NEEDS[kind]), let(_pieces(text, kind), placed)).otherwise(none)


def luhn(digits) -> F.Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def account_check(s) -> F.Column:
    """Whether a string is an international account number whose check digits are right."""
    moved = F.upper(F.concat(F.substring(s, 5, 30), F.left(s, F.lit(4))))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def _digits(s) -> F.Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s) -> F.Column:
    if kind == "ip":
        return s.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$")
    if kind == "card":
        return let(_digits(s), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> F.Column:
    return F.filter(_matches(F.col("text"), kind), lambda x: _valid(kind, x["s"]))


def _overlaps(spans, x) -> F.Column:
    """Whether x overlaps one of the sorted spans, which don't overlap each other: a bisection for the last that starts before x stops."""

    def halve(acc, _):
        mid = F.shiftright(acc["a"] + acc["b"], 1)
        up = F.get(spans, mid)["start"] < x["stop"]
        return F.when(acc["a"] >= acc["b"], acc).otherwise(F.struct(F.when(up, mid + 1).otherwise(acc["a"]).alias("a"), F.when(up, acc["b"]).otherwise(mid).alias("b")))

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(spans).cast("double"))).cast("int"))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size(spans).alias("b")), halve, lambda acc: F.get(spans, acc["a"] - 1))
    return F.when(F.size(spans) > 0, F.coalesce(last["stop"] > x["start"], F.lit(False))).otherwise(False)


def _before(x, words: tuple[str, ...]) -> F.Column:
    return F.lower(x["before"]).rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")")


def cues(x) -> list[F.Column]:
    """The features that make weak labels: published formats, check digits, assignment."""
    s = x["s"]
    return [s.rlike(KEY_FORMATS), account_check(s), x["before"].rlike(_ASSIGNED + "$")]


def features(x) -> list[F.Column]:
    """Numbers that describe a candidate's format and surroundings; the cues are first."""
    s, before, after = x["s"], x["before"], x["after"]
    n, size = F.length(_digits(s)), F.greatest(F.length(s), F.lit(1))
    distinct = F.size(F.array_distinct(F.split(F.left(s, F.lit(64)), "")))
    upper, lower = (F.length(F.regexp_replace(s, f"[^{c}]", "")) for c in ("A-Z", "a-z"))
    card = F.when(n.between(13, 19), luhn(_digits(s))).otherwise(False)
    return [
        *cues(x), *(x["kind"] == k for k in ADDED),
        size, n, n / size, upper / size, lower / size, (size - n - upper - lower) / size, distinct, distinct / F.least(size, F.lit(64)),
        s.rlike("^[0-9a-fA-F]+$"), s.rlike("^[0-9]+([.][0-9]+){3}$"), s.rlike("[.][A-Za-z]{2,}$"), s.rlike("[ .()-]"), s.rlike("[_/]"), card,
        before.rlike("[+(]$"), before.rlike("[\"']$") & after.rlike("^[\"']"), before.rlike("[:=]\\s*[\"']?$"), _before(x, SECRET_WORDS), _before(x, PERSON_WORDS),
    ]


CUES = 3


def scan(docs: DataFrame) -> DataFrame:
    """DataFrame[doc_id, text, email, ip, card, phone, cand]: arrays of the valid matches of each base kind, and of the candidates.

    cand: array<struct<kind, start, stop, label, overlaps, f array<double>>>.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({k: _checked(k) for k in BASE})
    wanted = {"number": lambda x: F.length(_digits(x["s"])) >= LEAST_DIGITS, "secret": lambda x: ~F.lower(x["before"]).rlike("(?:" + "|".join(DIGEST_WORDS) + r")\W{0,4}$")}
    proposed = F.concat(*(F.filter(_matches(F.col("text"), k, sides=True), wanted.get(k, lambda x: F.lit(True))) for k in ADDED))

    def look(x):
        overlaps = _overlaps(F.col("email"), x) | _overlaps(F.col("ip"), x) | _overlaps(F.col("card"), x) | _overlaps(F.col("phone"), x)
        label = overlaps
        for cue in cues(x):
            label = label | cue
        numbers = F.array(*(F.coalesce(f.cast("double"), F.lit(0.0)) for f in features(x)))
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), label.alias("label"), overlaps.alias("overlaps"), numbers.alias("f"))

    return found.withColumn("proposed", proposed).withColumn("cand", F.transform("proposed", look)).drop("proposed")


class Boosted:
    """Logistic boosting of trees that ask the same question of all rows of a level."""

    def __init__(self):
        self.trees: list[tuple[list[tuple[int, float]], list[float]]] = []
        self.threshold = math.inf

    def fit(self, counted: DataFrame, borders: list[np.ndarray]) -> None:
        """Trees for counted(), in which a code is the number of a feature's borders below its value."""
        total = counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
        if not total.good or not total.bad:
            return
        sums = _sums_here(counted, len(borders)) if small_enough(counted, FEW) else _sums(counted, len(borders))
        coded = []
        for _ in range(TREES):
            splits = []
            for level in range(DEPTH):
                g, h = sums(coded, splits)
                best = (-1.0, 0, 0)
                for i, b in enumerate(borders):
                    if not len(b):
                        continue
                    below_g, below_h = (v[: 1 << level, i, : len(b) + 1].cumsum(axis=1) / PARTS for v in (g, h))
                    above_g, above_h = below_g[:, -1:] - below_g[:, :-1], below_h[:, -1:] - below_h[:, :-1]
                    gain = (below_g[:, :-1] ** 2 / (below_h[:, :-1] + 1) + above_g**2 / (above_h + 1)).sum(axis=0)
                    n = int(np.argmax(np.round(gain, 9)))
                    best = max(best, (round(float(gain[n]), 9), -i, -n))
                i, n = -best[1], -best[2]
                if not len(borders[i]):
                    return
                splits.append((i, n))
            g, h = (v[:, 0].sum(axis=1) / PARTS for v in sums(coded, splits))
            leaves = [RATE * float(a / (b + 1)) for a, b in zip(g, h, strict=True)]
            coded.append((splits, leaves))
            self.trees.append(([(i, float(borders[i][n])) for i, n in splits], leaves))

    def calibrate(self, scored: DataFrame, precision: float) -> None:
        """The lowest score (0 at least) from which on the share of positives is at least `precision`. scored: f, label, n."""
        if not self.trees:
            return
        step = F.greatest(self.step(F.col("f")), F.lit(0)).alias("step")
        rows = sorted(scored.groupBy(step).agg(F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n")).collect(), reverse=True)
        if not rows:
            return
        good = np.flatnonzero(np.cumsum([r.good for r in rows]) >= precision * np.cumsum([r.n for r in rows]))
        if len(good):
            self.threshold = rows[good[-1]].step / STEPS

    def step(self, f) -> F.Column:
        """The score of a candidate with these features, in whole thousandths."""
        return F.floor((_score(self.trees, f) + 1e-9) * STEPS)

    def accepts(self, f) -> F.Column:
        """Whether a candidate with these features reaches the threshold."""
        return F.lit(False) if self.threshold == math.inf else self.step(f) >= round(self.threshold * STEPS)


def _leaf(splits, f) -> F.Column:
    return sum((F.when(F.get(f, F.lit(i)) > b, F.lit(1 << n)).otherwise(F.lit(0)) for n, (i, b) in enumerate(splits)), F.lit(0))


def _score(trees, f) -> F.Column:
    return sum((F.get(F.lit(list(leaves)), _leaf(splits, f)) for splits, leaves in trees), F.lit(0.0))


def _sums(counted: DataFrame, width: int):
    """What gives the sums of gradients and of curvatures by leaf, feature and code, in whole PARTS, for trees so far and splits of the next."""
    counted = saved(counted, "pii-codes")

    def of(trees, splits):
        code = F.col("codes")
        rows = counted.select("codes", "good", "bad", _leaf(splits, code).alias("leaf"), F.rint(PARTS / (1 + F.exp(-_score(trees, code)))).cast("long").alias("p"))
        grad = F.col("good") * (PARTS - F.col("p")) - F.col("bad") * F.col("p")
        hess = (F.col("good") + F.col("bad")) * F.shiftright(F.col("p") * (PARTS - F.col("p")), 24)
        each = rows.select("leaf", grad.alias("g"), hess.alias("h"), F.posexplode("codes").alias("i", "code"))
        g, h = (np.zeros((1 << DEPTH, width, BORDERS + 1), np.int64) for _ in range(2))
        for r in each.groupBy("leaf", "i", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            g[r.leaf, r.i, r.code], h[r.leaf, r.i, r.code] = r.g, r.h
        return g, h

    return of


def _sums_here(counted: DataFrame, width: int):
    """As _sums(), of few rows, on the driver."""
    rows = counted.collect()
    codes, good, bad = np.array([r.codes for r in rows], np.int64), np.array([r.good for r in rows], np.int64), np.array([r.bad for r in rows], np.int64)
    leaf_of = lambda splits: sum(((codes[:, i] > b).astype(np.int64) << n for n, (i, b) in enumerate(splits)), np.zeros(len(codes), np.int64))

    def of(trees, splits):
        score = sum((np.array(leaves)[leaf_of(s)] for s, leaves in trees), np.zeros(len(codes)))
        p, leaf = np.rint(PARTS / (1 + np.exp(-score))).astype(np.int64), leaf_of(splits)
        g, h = (np.zeros((1 << DEPTH, width, BORDERS + 1), np.int64) for _ in range(2))
        for i in range(width):
            np.add.at(g, (leaf, i, codes[:, i]), good * (PARTS - p) - bad * p)
            np.add.at(h, (leaf, i, codes[:, i]), (good + bad) * (p * (PARTS - p) >> 24))
        return g, h

    return of


def _rounded_up(v) -> F.Column:
    """v, rounded up to nine binary digits: whole numbers up to 512 stay, and there are at most 256 values between a number and its double."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(v)) - 8)
    return F.when(v > 0, F.ceil(v / unit) * unit).otherwise(F.lit(0.0))


def counted_vectors(scanned: DataFrame) -> DataFrame:
    """DataFrame[fold, label, f, n]: all candidates that scan() found, counted; in every second one the cues are blanked."""
    every = scanned.select(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).alias("fold"), F.xxhash64("doc_id", F.lit(3)).alias("k"), F.explode("cand").alias("x"))
    blank = F.pmod(F.xxhash64("k", "x.start", "x.kind"), F.lit(2)) == 0
    f = F.when(blank, F.concat(F.lit([0.0] * CUES), F.slice("x.f", CUES + 1, F.size("x.f")))).otherwise(F.col("x.f"))
    return every.select("fold", F.col("x.label").alias("label"), f.alias("f")).groupBy("fold", "label", "f").agg(F.count("*").alias("n"))


def fit(scanned: DataFrame, *, precision: float = PRECISION) -> Boosted:
    """Trees and threshold from all candidates that scan() found."""
    vectors, model = saved(counted_vectors(scanned), "pii-vectors"), Boosted()
    learnt, held = vectors.where("fold = 0"), vectors.where("fold = 1")
    values: dict[int, list[float]] = {}
    for r in learnt.select(F.posexplode("f").alias("i", "v")).select("i", _rounded_up(F.col("v")).alias("v")).distinct().collect():
        values.setdefault(r.i, []).append(r.v)
    if not values:
        return model
    # Borders at values that occur, BORDERS a feature at most.
    borders = [np.unique(np.quantile(np.sort(v)[:-1], np.linspace(0, 1, BORDERS), method="nearest")) if len(v) > 1 else np.zeros(0) for _, v in sorted(values.items())]
    cuts = F.lit([list(map(float, b)) for b in borders]).cast("array<array<double>>")
    code = lambda x, i: F.size(F.filter(F.get(cuts, i), lambda b: b < x))
    count = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    model.fit(learnt.groupBy(F.transform("f", code).alias("codes")).agg(count(True).alias("good"), count(False).alias("bad")), borders)
    model.calibrate(held, precision)
    return model


def find(scanned: DataFrame, model: Boosted) -> DataFrame:
    """scanned without cand, and added: array<struct<kind, start, stop>> of the accepted candidates that overlap no base span."""
    accepted = F.filter("cand", lambda x: ~x["overlaps"] & model.accepts(x["f"]))
    rank = lambda x: F.array_position(F.lit(list(ADDED[:3])), x["kind"])

    def named(xs):
        # A value that is both assigned and an identifier is one span.
        assigned = F.filter(xs, lambda x: x["kind"] == "assigned")
        once = let(assigned, lambda ys: F.filter(xs, lambda x: (x["kind"] != "secret") | ~_overlaps(ys, x)))
        spans = F.transform(once, lambda x: F.struct(F.when(x["kind"] == "assigned", F.lit("secret")).otherwise(x["kind"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
        return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))

    return scanned.withColumn("added", let(accepted, named)).drop("cand")


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, and the numbers of added and of all spans, from find()."""
    base = F.array_join(F.filter(F.array(*(_joined(F.col(k)) for k in BASE)), lambda x: x != ""), ",")
    n = sum((F.size(k) for k in BASE), F.size("added")).cast("long")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(_joined(F.col("added")), F.lit(""))).alias("spans"), F.size("added").cast("long").alias("n_added"), n.alias("n_spans"),
    )


#: Code points of a piece of text that redaction cuts from.
PIECE = 4096


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; overlapping spans are one, named after the first."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    spans = F.array_sort(F.concat(*(plain(k) for k in (*BASE, "added"))))

    def part(pieces, start, stop):
        a = F.floor(start / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, a + 1, F.floor(stop / PIECE).cast("int") - a + 1), "")
        return F.substring(some, start - a * PIECE + 1, F.greatest(stop - start, F.lit(0)))

    def cut(pieces):
        def joined(xs):
            def filled(ends):
                put = lambda x, i: F.when(x["start"] < F.get(ends, i), F.lit("")).otherwise(F.concat(part(pieces, F.get(ends, i), x["start"]), F.lit("<"), x["kind"], F.lit(">")))
                last = F.greatest(F.element_at(ends, -1), F.element_at(xs, -1)["stop"])
                return F.concat(F.array_join(F.transform(xs, put), ""), part(pieces, last, F.length("text")))

            return let(running(F.transform(xs, lambda x: x["stop"]), lambda a, b: F.greatest(a, b), F.lit(0)), filled)

        return let(spans, joined)

    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    n = sum((F.size(k) for k in BASE), F.size("added"))
    return found.select("doc_id", F.when(n == 0, F.col("text")).otherwise(let(pieces, cut)).alias("text"))
