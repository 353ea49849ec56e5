"""Personal data: proposed spans, boosted trees over their format and context, calibrated thresholds.

Everything that touches the corpus is a DataFrame expression.  Matches of a pattern are
``regexp_extract_all``; the gaps between them are ``split`` by the same pattern, and
running sums of both lengths give code point positions, all within the row.

1. Base: the four formats with their checks.  These spans always stay.
2. Generators propose spans of high recall that may overlap base spans and each other: base
   formats that fail their check, looser formats, and, for a kind of its own, secrets: what is
   assigned to a password, token or key, and every long run of letters and digits.
3. Trees: boosted on sentences made from a seed (``training_texts``), where what is personal
   and what only looks so share formats.  Candidates there get their features from the same
   expressions as the corpus; trees come back as nested CASE expressions.
4. On held-out sentences the trees' log odds are scaled to probabilities, and for each
   kind the lowest one is taken from which on at least ``precision`` of the candidates are
   right.  A candidate gives way to a neighbour of its kind that it overlaps and that scores
   more; base spans score most.

Patterns use possessive repeats and start only where a match can, and are tried only on texts
with a character that they need, so the time is in proportion to the text whatever it holds.

Nulls and edge cases: null texts are empty; texts without a match have no spans, and the
digest of the empty list; repeated rows give repeated rows; spans of different kinds may
overlap; positions count code points, the end exclusive; an empty table gives an empty
result; columns may have any name that doesn't start with ``__pl_``.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base formats, as stated; "++" and "\G" only save time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words that announce a secret that is assigned to them.
_SECRET = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
#: Looser formats, by generator.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9]{4}+(?:[._/][0-9]{4,6}+){2,3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "assigned": r"(?i)(?<![A-Za-z0-9])(?:" + _SECRET + r")[\"']? ?[:=] ?[\"']?[^\s\"',;]{6,200}+[\"']?",
    "token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
}
_KIND_OF = {k: KINDS.index(k) for k in KINDS} | {"assigned": 4, "token": 4}
#: SQL over a text ``t``: without this none of a pattern's matches can be in it.
_NEEDS = {
    "base_email": "contains(t, '@')", "base_ip": "t rlike '[0-9][.]'", "base_card": "t rlike '[0-9]'", "base_phone": "contains(t, '+')",
    "loose_email": "t rlike '[\\\\[({] ?[aA][tT]'", "loose_ip": "t rlike '[:\\\\[]'", "loose_card": "t rlike '[0-9][._/]'", "loose_phone": "t rlike '[0-9][ .)-]'", "loose_assigned": "t rlike '[:=]'", "loose_token": "t rlike '[0-9]'",
}
#: Words that announce a kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|account|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax)\b",
    "secret": r"(?i)(?:" + _SECRET + r"|key)\W*$",
}
#: Words that announce a number or run of letters that is no personal data.
OTHER = r"(?i)\b(?:order|part|item|invoice|ref|serial|sku|commit|revision|checksum|digest|sha\w*|md5|build|version|page|id|uuid|etag|chapter)\W*$"
FEATURES = ("generator", "n_chars", "n_digits", "n_marks", "checked", "announced", "otherwise", "joined_before", "joined_after", "distinct", "n_spaces", "n_upper", "n_hex", "switches", "prefixed")
_BLOCK = 256


def _running(lengths: str) -> str:
    """SQL: running sums (bigint) of an int array, by blocks, so that long arrays stay cheap."""
    inner = lambda a: f"aggregate({a}, cast(array() as array<bigint>), (acc, v) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0L) + v)))"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), b -> slice({lengths}, b * {_BLOCK} + 1, {_BLOCK}))"
    sums = f"transform({blocks}, x -> aggregate(x, 0L, (s, v) -> s + v))"
    return f"flatten(zip_with({blocks}, {inner(sums)}, (x, upto) -> transform({inner('x')}, r -> r + upto - aggregate(x, 0L, (s, v) -> s + v))))"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, length({d}) - i + 1, 1) as int)"
    return f"(aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0)"


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: SQL over a match ``m``: does it pass its kind's check.
CHECK = {
    "email": "true",
    "ip": f"m rlike {_sql('^' + _OCTET + '(?:[.]' + _OCTET + '){3}$')}",
    "card": f"case when length({_digits('m')}) between 14 and 19 then {_luhn(_digits('m'))} else false end",
    "phone": f"(length({_digits('m')}) between 10 and 15)",
}


_SPANS = "array<struct<s:bigint,e:bigint,m:string,before:string,after:string>>"


def _matches(rows: DataFrame, text: str, patterns: dict[str, str], to: str) -> DataFrame:
    """Adds __pl_{to}_{name}: array of (s, e, m, before, after), the match with up to 24 and 12 characters around it."""
    # each step is used more than once by the next, so Spark computes it once
    needs = {k: re.sub(r"\bt\b", text, _NEEDS[f"{to}_{k}"], count=1) for k in patterns}
    rows = rows.select("*", *[F.expr(f"if({needs[k]}, regexp_extract_all({text}, {_sql(p)}, 0), null)").alias(f"__pl_m_{k}") for k, p in patterns.items()])
    rows = rows.select("*", *[F.when(F.size(f"__pl_m_{k}") > 0, F.split(F.col(text), p, -1)).alias(f"__pl_g_{k}") for k, p in patterns.items()])
    lengths = "flatten(zip_with({g}, {m}, (g, m) -> array(length(g), coalesce(length(m), 0))))"
    rows = rows.select("*", *[F.expr(f"if(__pl_g_{k} is null, null, {lengths.format(g=f'__pl_g_{k}', m=f'__pl_m_{k}')})").alias(f"__pl_l_{k}") for k in patterns])
    rows = rows.select("*", *[F.expr(f"if(__pl_l_{k} is null, null, {_running(f'__pl_l_{k}')})").alias(f"__pl_r_{k}") for k in patterns])
    spans = "coalesce(transform(__pl_m_{k}, (m, i) -> named_struct('s', __pl_r_{k}[2 * i], 'e', __pl_r_{k}[2 * i + 1], 'm', m, 'before', right(__pl_g_{k}[i], 24), 'after', left(__pl_g_{k}[i + 1], 12))), array())"
    rows = rows.select("*", *[F.expr(f"if(__pl_g_{k} is null, cast(array() as {_SPANS}), {spans.format(k=k)})").alias(f"__pl_{to}_{k}") for k in patterns])
    return rows.drop(*[f"__pl_{x}_{k}" for x in "mglr" for k in patterns])


def _featured(spans: str, generator: str, number: int, loose: bool) -> str:
    """SQL: array of (s, e, k, base, f) of the spans of a generator; ``base``: a base format that passes its check."""
    kind = KINDS[_KIND_OF[generator]]
    check = {"card": CHECK["card"], "secret": "true"}.get(kind, "true") if loose else CHECK[kind]
    before, marks = "right(c.before, 24)", lambda p: f"least(length(regexp_replace(left(m, 64), '{p}', '')), 64)"
    f = {
        "generator": str(number), "n_chars": "least(length(m), 64)", "n_digits": marks("[^0-9]"), "n_marks": marks("[A-Za-z0-9]"), "checked": f"if({check}, 1, 0)",
        "announced": f"if({before} rlike {_sql(CONTEXT[kind])}" + (f" or m rlike {_sql('(?i)^(?:' + _SECRET + ')')}" if kind == "secret" else "") + ", 1, 0)", "otherwise": f"if({before} rlike {_sql(OTHER)}, 1, 0)",
        "joined_before": "if(c.before rlike '[A-Za-z0-9]$', 1, 0)", "joined_after": "if(c.after rlike '^[A-Za-z0-9]', 1, 0)", "distinct": "size(array_distinct(split(left(m, 64), '')))", "n_spaces": marks("[^ ]"),
        "n_upper": marks("[^A-Z]"), "n_hex": marks("[^0-9a-f]"), "switches": "least(regexp_count(m, '[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])'), 32)", "prefixed": "if(m rlike '^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-)', 1, 0)",
    }
    own = lambda sql: re.sub(r"\bm\b(?! *->|')", "c.m", sql)
    body = ", ".join(f"'{n}', cast({own(f[n])} as double)" for n in FEATURES)
    return f"transform({spans}, c -> named_struct('s', c.s, 'e', c.e, 'k', {KINDS.index(kind)}, 'base', coalesce({own('false' if loose else CHECK[kind])}, false), 'f', named_struct({body})))"


def candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds __pl_base (checked base spans with s, k, e) and __pl_more (all other candidates with features)."""
    rows = _matches(_matches(rows, text, BASE, "base"), text, LOOSE, "loose")
    every = [_featured(f"__pl_base_{g}", g, i, False) for i, g in enumerate(BASE)] + [_featured(f"__pl_loose_{g}", g, len(BASE) + i, True) for i, g in enumerate(LOOSE)]
    rows = rows.select("*", F.expr(f"concat({', '.join(every)})").alias("__pl_all"))
    rows = rows.select("*", F.expr("transform(filter(__pl_all, c -> c.base), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))").alias("__pl_base"), F.expr("filter(__pl_all, c -> not c.base)").alias("__pl_more"))
    return rows.drop("__pl_all", *[f"__pl_base_{g}" for g in BASE], *[f"__pl_loose_{g}" for g in LOOSE])


def training_texts(n: int = 4000, seed: int = 17) -> list[tuple[str, list[tuple[str, str]]]]:
    """Sentences made from a seed: text, and the (kind, string) pairs in it that are personal data.

    Formats of real and of other values overlap; what precedes them and their digits tell more or less clearly.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnorstuv") for _ in range(rng.randint(2, 8)))
    of = lambda letters, low, high=None: "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))
    num = lambda k: of("0123456789", k)
    hexa, base32, base62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def luhn(k: int) -> str:
        d = num(k - 1)
        s = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        return d + str(-s % 10)

    def grouped(d: str, mark: str) -> str:
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def one(*makers):
        return rng.choice(makers)()

    phone = lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(num(3), num(3), num(4))
    assigned = lambda value: f"{rng.choice(['password', 'token', 'api_key', 'secret', 'pwd', 'Password', 'auth'])}{rng.choice(['=', ': ', ' = ', ':'])}{rng.choice(['', chr(34)])}{value}"
    key = lambda: one(lambda: rng.choice(["AKIA", "ASIA"]) + of(base32, 16), lambda: "ghp_" + of(base62, 36), lambda: "sk-" + of(base62, 24, 48))
    real = {
        "email": lambda: f"{word()}.{word()}{rng.choice([' [at] ', '(at)', ' (at) ', '[at]'])}{word()}{rng.choice(['.', ' [dot] ', '(dot)'])}{rng.choice(['com', 'org', 'net'])}",
        "ip": lambda: one(lambda: "[.]".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8))),
        "card": lambda: grouped(luhn(16), rng.choice("._/")),
        "phone": phone,
        "secret": lambda: one(key, lambda: assigned(one(lambda: of(hexa, 12, 40), lambda: of(base62, 8, 32), lambda: word() + num(2) + rng.choice("!#$%"))), lambda: of(base62, 24, 44)),
    }
    false = {
        "email": lambda: f"{word()} (at {word()}) {word()}" if rng.random() < 0.7 else f"{word()} (at) {word()}.{word()}", "ip": lambda: one(lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: "[.]".join(str(rng.randint(256, 999)) for _ in range(4))),
        "card": lambda: one(lambda: num(rng.randint(6, 13)), lambda: num(16), lambda: num(20), lambda: grouped(num(16), rng.choice("._/")), lambda: f"{num(4)}-{num(2)}-{num(2)}"),
        "phone": lambda: one(lambda: f"+{num(1)} {num(3)}", lambda: f"+{num(3)}-{num(3)}", phone, phone),
        "secret": lambda: one(
            lambda: of(hexa, 32, 64), lambda: "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join([word(), num(4), *(word() for _ in range(3))]), lambda: "-".join([word(), word(), word(), num(2), word()]),
            lambda: num(rng.randint(16, 24)), lambda: of(base62, 20, 64) + "=", lambda: of(base32, 16, 20), lambda: f"{rng.choice(['token', 'password', 'secret'])}: {word()}{word()}", lambda: f"{word()}={num(4)}-{num(6)}-{num(6)}",
        ),
    }
    announce = {"email": ["mail", "contact"], "ip": ["server", "login from"], "card": ["card", "payment"], "phone": ["phone", "call"], "secret": ["key", "token", "secret"]}
    other = ["order", "part", "ref", "commit", "checksum", "build", "id", "serial"]
    out = []
    for _ in range(n):
        kind = rng.choice(KINDS)
        true = rng.random() < 0.5
        value = (real if true else false)[kind]()
        p = rng.random()
        lead = rng.choice(announce[kind]) if p < (0.6 if true else 0.03) else rng.choice(other) if p > (0.97 if true else 0.5) else word()
        text = " ".join([*(word() for _ in range(rng.randint(1, 6))), lead, value + ('"' if value.count('"') == 1 else ""), *(word() for _ in range(rng.randint(0, 5)))])
        out.append((text, [(kind, value)] if true else []))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, depth: int = 3) -> tuple[float, list[tuple]]:
    """Gradient boosting of trees on log loss: the starting log odds, and trees (feature, cut, left, right) of leaves or trees."""
    p0 = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(p0 / (1 - p0)))
    z, out = np.full(len(y), base), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (1e-9, None, None)
        score = lambda a, b: a * a / (b + 1.0)
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            gs, hs, vs = np.cumsum(g[rows][order]), np.cumsum(h[rows][order]), v[order]
            at = np.flatnonzero(vs[1:] > vs[:-1])
            if len(at):
                gain = score(gs[at], hs[at]) + score(gs[-1] - gs[at], hs[-1] - hs[at]) - score(gs[-1], hs[-1])
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float((vs[at[k]] + vs[at[k] + 1]) / 2))
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        _, j, cut = split(rows, g, h) if depth else (0, None, None)
        if j is None:
            value = round(float(-rate * g[rows].sum() / (h[rows].sum() + 1.0)), 6)
            z[rows] += value
            return value
        low = x[rows, j] <= cut
        return (j, cut, grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth))
    return base, out


def tree_sql(tree, row: str) -> str:
    """A tree as a CASE expression over the struct ``row``."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    j, cut, low, high = tree
    return f"case when {row}.{FEATURES[j]} <= {cut!r}D then {tree_sql(low, row)} else {tree_sql(high, row)} end"


def evaluate(model: tuple[float, list[tuple]], x: np.ndarray) -> np.ndarray:
    def leaf(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([model[0] + sum(leaf(t, r) for t in model[1]) for r in x])


def scaled(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that turn log odds ``z`` into calibrated ones, by Newton steps on log loss with targets a little inside 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return a, b


@cache
def _trained(rows: tuple, precision: float) -> tuple[tuple[float, list[tuple]], dict[int, float]]:
    """Rows: features, kind, sentence, label.  The trees, scaled, and the threshold of each kind in calibrated log odds."""
    x, kind, sentence, y = (np.array([r[i] for r in rows], dtype=float) for i in range(4))
    held = sentence % 3 == 0
    start, trees = boost(x[~held], y[~held])
    a, b = scaled(evaluate((start, trees), x[held]), y[held])
    scale = lambda t: (t[0], t[1], scale(t[2]), scale(t[3])) if isinstance(t, tuple) else round(a * t, 6)
    model = (a * start + b, [scale(t) for t in trees])
    z, thresholds = evaluate(model, x[held]), {}
    for k in range(len(KINDS)):
        zs, ys = z[kind[held] == k], y[held][kind[held] == k]
        good = [c for c in sorted(set(zs)) if ys[zs >= c].sum() / ((zs >= c).sum() + 1) >= precision]  # one more, wrong: few candidates prove little
        below = zs[zs < good[0]] if good else zs
        # halfway to the next lower score
        thresholds[k] = float("inf") if not good else float(good[0] + below.max()) / 2 if len(below) else float(good[0])
    return model, thresholds


def train(spark: SparkSession, n: int = 4000, precision: float = 0.9) -> tuple[tuple[float, list[tuple]], dict[int, float]]:
    """The trees, and for each kind the calibrated log odds from which a candidate is selected.

    The sample is ``n`` generated sentences, whatever the corpus; their candidates' features are collected.
    """
    return _trained(tuple(training_rows(spark, training_texts(n))), precision)


def training_rows(spark: SparkSession, texts: list[tuple[str, list[tuple[str, str]]]]) -> list[tuple]:
    """(features, kind, sentence, label) of the candidates of labelled sentences: 1 for half or more of personal data of its kind."""
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")
    # no explode here: the filter that Spark infers from one is pushed down through every step, and grows with each
    data = []
    for r in sorted(candidates(rows).select("i", "__pl_more").collect(), key=lambda r: r["i"]):
        text, truth = texts[r["i"]]
        real = [(k, at, at + len(v)) for k, v in truth for at in [text.find(v)]]
        for c in r["__pl_more"]:
            label = any(k == KINDS[c["k"]] and s <= c["s"] and c["e"] <= e + 1 and 2 * (c["e"] - c["s"]) >= e - s for k, s, e in real)
            data.append((tuple(c["f"][f] for f in FEATURES), c["k"], r["i"], int(label)))
    return data


def find(docs: DataFrame, model: tuple[tuple[float, list[tuple]], dict[int, float]] | None = None) -> DataFrame:
    """All columns of ``docs`` with __pl_base and __pl_spans: arrays of (s, k, e), in order, of base spans and of all selected."""
    (base, trees), thresholds = model or train(docs.sparkSession)
    rows = candidates(docs.withColumn("__pl_text", F.coalesce(F.col("text").cast("string"), F.lit(""))), "__pl_text").drop("__pl_text")
    score = " + ".join([f"{base!r}D", *(tree_sql(t, "c.f") for t in trees)])
    limit = "case c.k " + " ".join(f"when {k} then {t!r}D" if np.isfinite(t) else f"when {k} then double('infinity')" for k, t in thresholds.items()) + " end"
    rows = rows.select("*", F.expr(f"transform(__pl_more, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'z', {score}))").alias("__pl_scored")).drop("__pl_more")
    chosen = f"filter(__pl_scored, c -> c.z >= {limit})"
    sure = "transform(__pl_base, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'z', double('infinity')))"
    rows = rows.select("*", F.expr(f"if(size(__pl_scored) = 0, {sure}, array_sort(concat({sure}, {chosen})))").alias("__pl_a")).drop("__pl_scored")
    # twice: what a dropped neighbour hid shows then
    for a, b in (("__pl_a", "__pl_b"), ("__pl_b", "__pl_c")):
        left = f"coalesce(i > 0 and {a}[i - 1].k = c.k and {a}[i - 1].e > c.s and {a}[i - 1].z >= c.z, false)"
        right = f"coalesce({a}[i + 1].k = c.k and {a}[i + 1].s < c.e and {a}[i + 1].z > c.z, false)"
        rows = rows.select("*", F.expr(f"if(size({a}) < 2, {a}, filter({a}, (c, i) -> c.z = double('infinity') or not ({left} or if(i + 1 < size({a}), {right}, false))))").alias(b)).drop(a)
    # the partition is never below 0: a step that isn't deterministic keeps a caller's filter from being pushed into, and multiplied by, all steps before
    spans = "if(spark_partition_id() < 0, null, array_sort(transform(__pl_c, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))))"
    own = [c for c in rows.columns if c not in ("__pl_base", "__pl_c")]
    return rows.select(*[F.col(f"`{c}`") for c in own], F.expr("array_sort(__pl_base)").alias("__pl_base"), F.expr(spans).alias("__pl_spans"))


def _listed(spans: str) -> Column:
    names = "case c.k " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    return F.expr(f"array_join(transform({spans}, c -> concat({names}, ':', cast(c.s as string), ':', cast(c.e as string))), ',')")


def report(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans): counts and digest of base spans, all spans, and counts of them."""
    rows = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    counts = [F.expr(f"cast(size(filter(__pl_base, c -> c.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    more = [F.expr("cast(size(filter(__pl_spans, c -> c.k = 4)) as bigint)").alias("n_secret"), F.size("__pl_spans").cast("long").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(_listed("__pl_base").cast("binary"), 256).alias("base_sha256"), _listed("__pl_spans").alias("spans"), *more)


def redact(docs: DataFrame, model=None) -> DataFrame:
    """All columns of ``docs``, the text's spans replaced by ``[KIND]`` (where spans overlap, by that of the first)."""
    rows = find(docs, model)
    names = "case c.k " + " ".join(f"when {i} then '[{k.upper()}]'" for i, k in enumerate(KINDS)) + " end"
    piece = f"concat(substr(text, cast(a.at as int) + 1, cast(c.s - a.at as int)), {names})"
    done = f"aggregate(__pl_spans, named_struct('at', 0L, 'out', ''), (a, c) -> if(c.s < a.at, named_struct('at', greatest(a.at, c.e), 'out', a.out), named_struct('at', c.e, 'out', concat(a.out, {piece}))), a -> concat(a.out, substr(text, cast(a.at as int) + 1)))"
    return rows.withColumn("text", F.expr(f"if(size(__pl_spans) = 0, text, {done})")).select(docs.columns)
