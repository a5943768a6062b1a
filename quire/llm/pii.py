"""Personal data and secrets: high-recall candidates, boosted trees, calibrated thresholds; DataFrame operations only.

Patterns propose spans.  Those of the four base kinds that pass their checks always
stay.  Generators propose more, which overlap each other and failed base matches;
gradient-boosted trees score them by format and context, those above their kind's
threshold are candidates, and of overlapping candidates the best one is added.  There
are no labels, so the trees are fitted in numpy on the driver on examples put into
windows of a bounded sample of the documents, and calibrated on other windows; they run
as nested CASE expressions.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those above and one of its own.
ADDED = (*KINDS, "secret")
MARK, BLOCK, NEAR = "\u0001", 64, 32
#: Documents whose windows the examples stand in, examples of each generator, and least precision of a threshold.
SAMPLE, EXAMPLES, PRECISION = 2000, 240, 0.99

#: Possessive where nothing could be given back, so that long runs need no stack; \G: a match may follow the last one directly.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall proposals of each kind.  They may overlap one another, and base matches that fail their check.
GENERATORS = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: @ ?|@ |＠)[A-Za-z0-9-]{1,63}(?: ?\. ?[A-Za-z0-9-]{1,63}){1,4}",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])",
        r"(?i)(?<![0-9A-F:])(?:[0-9A-F]{1,4}:){2,7}(?::?[0-9A-F]{1,4}){1,6}(?![0-9A-F:])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}(?:[._/:]{1,2}[0-9]{4}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{16,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])",
        r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -]?[0-9])",
    ),
    "phone": (
        r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        r"(?<![0-9])00[1-9][0-9]{0,2}[ ./-]?(?:\([0-9]{1,4}\) ?)?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,4}(?![0-9])",
        r"(?<![0-9+])0[1-9][0-9]{1,3}[ /-] ?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9])",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
    ),
    "secret": (
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|glpat-)[A-Za-z0-9_-]{12,}",
        r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth)[\"']?(?: is)? {0,2}[:= ] {0,2}[\"']?[^\s\"'<>,;]{8,200}",
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,200}(?![A-Za-z0-9+/_-])",
    ),
}
#: Generators whose span is only the end of what they match, by kind and number.
ENDS = {("secret", 1): r"[^\s\"'<>,;:=]+$"}
PREFIXES, NAMES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xox", "glpat-"), ("passw", "passph", "pwd", "secret", "token", "key", "auth")
_SPEAKS = r"(?i)(?:call|phone|tel|mobile|fax|cell|mail|contact|reach|write|card|visa|pay|ip|host|server|address|from|password|passwd|passphrase|pwd|secret|token|key|auth)[^A-Za-z]{0,4}(?:me |us |at |to |is |no |number |: |= ?)*[\"']?$"
_OTHER = r"(?i)(?:version|order|invoice|isbn|ref|part|total|page|serial|sku|build|case|lot|batch|figure|look|was|be|stay|met|commit|hash|sha|checksum|id)[^A-Za-z]{0,4}(?:no |number |is |: |#)*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that the work for n elements is about 64 n."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def summed(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))

        def placed(sums: Column) -> Column:
            def block(b: Column) -> Column:
                return let(F.aggregate(F.slice(sums, F.lit(1), b), zero, add), lambda at: let(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), lambda part: F.transform(part, lambda _, i: at + F.aggregate(F.slice(part, F.lit(1), i), zero, add))))

            return F.flatten(F.transform(blocks, block))

        return let(F.transform(blocks, lambda b: F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), zero, add)), placed)

    return let(lengths, summed)


def _cut(text: Column, pattern: str) -> Column:
    """The text parted at each match: matches stand at the odd positions (from 0)."""
    return F.split(F.regexp_replace(F.translate(text, MARK, "\u0002"), pattern, MARK + "$0" + MARK), MARK)


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, exclusive), hit, before and after of each match, leftmost first and none overlapping."""

    def spans(parts: Column) -> Column:
        def with_starts(at: Column) -> Column:
            odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
            return F.transform(odd, lambda i: F.struct(at[i].alias("start"), (at[i] + F.length(parts[i])).alias("end"), parts[i].alias("hit"), F.right(parts[i - 1], F.lit(NEAR)).alias("before"), F.left(parts[i + 1], F.lit(NEAR)).alias("after")))

        return F.when(F.size(parts) > 2, let(running(F.transform(parts, lambda p: F.length(p).cast("long"))), with_starts)).otherwise(_none())

    return let(_cut(text, pattern), spans)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>)")


def candidates(text: Column, kind: str, g: int) -> Column:
    """The matches of a generator, cut down to its span where that is only their end."""
    found = matches(text, GENERATORS[kind][g])
    if (kind, g) not in ENDS:
        return found

    def cut(m: Column) -> Column:
        hit = F.regexp_extract(m["hit"], ENDS[kind, g], 0)
        n = F.length(m["hit"]) - F.length(hit)
        return F.struct((m["start"] + n).alias("start"), m["end"].alias("end"), hit.alias("hit"), F.right(F.concat(m["before"], F.left(m["hit"], n)), F.lit(NEAR)).alias("before"), m["after"].alias("after"))

    return F.filter(F.transform(found, cut), lambda m: m["hit"] != "")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def term(a: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), term) % 10 == 0)


def passes(kind: str, hit: Column) -> Column:
    """The base kind's own check of a match."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: (F.length(d) <= 3) & (F.when(F.length(d) <= 3, d.cast("int")).otherwise(999) <= 255)))
    if kind == "card":
        return let(digits(hit), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _tried(text: Column, kind: str, g: int) -> Column:
    """A cheap condition without which a generator finds nothing worth scoring."""
    if kind == "email":
        return _any(text, "[at]", "(at)") | (F.contains(text, F.lit(" at ")) & _any(text, " dot ", ".com", ".org", ".net", ".de", ".io", ".edu")) if g == 0 else _any(text, "@", "＠")
    if kind == "ip":
        return _any(text, "[.]", "(.)", "[dot]", "(dot)") if g == 0 else F.contains(text, F.lit(":")) & text.rlike(":[0-9A-Fa-f]{0,4}:")
    if kind == "secret":
        return _any(text, *PREFIXES) if g == 0 else _any(F.lower(text), *NAMES) if g == 1 else text.rlike("[0-9A-Z][A-Za-z0-9+/_-]{15}")
    return text.rlike("[0-9][0-9 ()./_:-]{5,}[0-9]")


def _wanted(text: Column, kind: str) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def base_spans(text: Column, kind: str) -> Column:
    return F.when(_wanted(text, kind), F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["hit"]))).otherwise(_none())


def features(kind: str, generator: int, m: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    hit, num = m["hit"], digits(m["hit"])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    small_parts = F.forall(F.split(F.regexp_replace(hit, "[^0-9]+", "."), r"\."), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return [
        F.lit(float(ADDED.index(kind))),
        F.lit(float(generator)),
        F.length(hit).cast("double"),
        F.length(num).cast("double") / F.length(hit),
        F.length(num).cast("double"),
        F.size(F.array_distinct(F.split(hit, ""))).cast("double"),
        flag(F.when(F.length(num) >= 2, luhn(num)).otherwise(False)),
        flag(m["before"].rlike(_SPEAKS)),
        flag(m["before"].rlike(_OTHER)),
        flag(hit.rlike(_TLD.pattern)),
        flag(hit.rlike(_HIDDEN.pattern)),
        flag(small_parts),
        flag(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")),
        F.length(F.regexp_replace(hit, "[^A-Z]", "")).cast("double") / F.length(hit),
        F.length(F.regexp_replace(hit, "(?i)[^aeiou]", "")).cast("double") / F.length(hit),
    ]


_COMPILED = {k: [re.compile(p) for p in ps] for k, ps in GENERATORS.items()}
_ENDS = {k: re.compile(p) for k, p in ENDS.items()}
_TLD = re.compile(r"(?i)(?:dot |\.|dot[\])] ?|\. )(?:com|org|net|edu|de|fr|es|io|gov|info|co|uk)$")
_HIDDEN = re.compile(r"[\[(](?:at|dot|\.)[\])]|^\([0-9]{3}\)")


def plain_features(kind: str, generator: int, hit: str, before: str) -> list[float]:
    """What ``features`` gives, of a string: the driver's few training examples need no Spark job."""
    num = re.sub("[^0-9]", "", hit)
    total = sum(d if k % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d for k, d in enumerate(map(int, reversed(num))))
    small = all(len(p) <= 3 and int(p or 0) <= 255 for p in re.sub("[^0-9]+", ".", hit).split("."))
    flags = len(num) >= 2 and total % 10 == 0, re.search(_SPEAKS, before), re.search(_OTHER, before), _TLD.search(hit), _HIDDEN.search(hit), small, re.search("[0-9]", hit) and re.search("[A-Za-z]", hit)
    shares = len(re.sub("[^A-Z]", "", hit)) / len(hit), len(re.sub("(?i)[^aeiou]", "", hit)) / len(hit)
    return [float(ADDED.index(kind)), float(generator), float(len(hit)), len(num) / len(hit), float(len(num)), float(len(set(hit))), *(float(bool(f)) for f in flags), *shares]


class Trees:
    """Gradient boosting of depth-2 regression trees on the logistic loss."""

    def __init__(self, rounds: int = 24, rate: float = 0.4):
        self.rounds, self.rate, self.trees, self.bias = rounds, rate, [], 0.0

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        """Gain, feature and greatest value on the left of the best split; feature -1 if none gains."""
        best = (1e-9, -1, 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, left_g, left_h = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            gain = left_g[cut] ** 2 / (left_h[cut] + 1) + (g.sum() - left_g[cut]) ** 2 / (h.sum() - left_h[cut] + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, float(v[cut[k]]))
        return best

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        _, f, cut = self._split(x, g, h) if depth and len(x) else (0, -1, 0)
        if f < 0:
            return float(-self.rate * g.sum() / (h.sum() + 1))
        left = x[:, f] <= cut
        return f, cut, self._tree(x[left], g[left], h[left], depth - 1), self._tree(x[~left], g[~left], h[~left], depth - 1)

    def _value(self, node, x: np.ndarray) -> np.ndarray:
        if isinstance(node, float):
            return np.full(len(x), node)
        f, cut, a, b = node
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        z = np.zeros(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(self._tree(x, p - y, p * (1 - p), 2))
            z += self._value(self.trees[-1], x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))))

    def column(self, xs: list[Column]) -> Column:
        def node(n) -> Column:
            return F.lit(n) if isinstance(n, float) else F.when(xs[n[0]] <= n[1], node(n[2])).otherwise(node(n[3]))

        return 1 / (1 + F.exp(-sum((node(t) for t in self.trees), F.lit(0.0))))


def _windows(docs: DataFrame) -> list[str]:
    """Pieces of some 120 characters of the SAMPLE documents that come first by the hash of their text, each at a place its hash gives."""
    h = F.xxhash64("text")
    at = F.pmod(h, F.greatest(F.length("text") - 120, F.lit(1))).cast("int") + 1
    piece = F.regexp_replace(F.substr("text", at, F.lit(120)), "[0-9@\u0001]", "x")
    rows = docs.where("text IS NOT NULL AND text <> ''").select(h.alias("h"), piece.alias("piece")).distinct().orderBy("h", "piece").limit(SAMPLE).collect()
    return [r.piece for r in rows] or ["some words that stand before what is looked for and after it"]


def _examples(windows: list[str], n: int = EXAMPLES, seed: int = 3) -> list[tuple[str, str, int]]:
    """(kind, text, label): personal data in loose forms and what looks like it, each in a window of the documents' own text."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8)))
    any_of = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(ok: bool, sep: str) -> str:
        body = "4" + d(14)
        total = sum(c if k % 2 else (2 * c - 9 if c > 4 else 2 * c) for k, c in enumerate(map(int, body)))
        last = str((-total) % 10 if ok else (1 - total) % 10)
        return sep.join((body + last)[k : k + 4] for k in (0, 4, 8, 12))

    def email(good: bool) -> str:
        if not good:
            return rng.choice([f"{rng.choice(['look', 'was', 'met ' + w(), 'stay', w()])} at {w()}.{w().capitalize()}", f"{d(2)} @ {d(1)}.{d(2)} {w()}", f"{w()} @ {w()} . {w().capitalize()}"])
        host = rng.choice(["com", "org", "net", "de", "io"])
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", "[dot]"), ("(at)", "."), (" @ ", "."), ("@ ", " . "), ("＠", ".")])
        return rng.choice(["mail me: ", "contact ", "write to ", ""]) + f"{w()}.{w()}{at}{w()}{dot}{host}"

    def ip(good: bool) -> str:
        if rng.random() < 0.5:
            return f"{rng.choice(['host ', 'from ', 'server: ', ''])}{':'.join(any_of(hexed, 4) for _ in range(8))}" if good else f"{rng.choice(['at ', 'time ', ''])}{d(2)}:{d(2)}:{d(2)}"
        return f"{rng.choice(['host ', 'from ', 'server: ', ''])}{'[.]'.join(str(rng.randint(1, 254)) for _ in range(4))}" if good else f"{rng.choice(['version ', 'build ', 'part '])}{rng.randint(300, 999)}[.]{d(1)}[.]{d(1)}[.]{d(1)}"

    def number(good: bool) -> str:
        sep = rng.choice(["", " ", "-", ".", "_", "/", ":"])
        if good and sep in ("", " ", "-"):  # in a chain that is too long as a whole
            return rng.choice([f"{card(True, sep)} {card(True, sep)}", f"{d(4)} {card(True, sep)}", f"{card(True, sep)} {d(4)} {d(4)}"])
        return rng.choice(["card: ", "visa ", "pay ", ""]) + card(True, sep) if good else rng.choice(["serial ", "order ", "invoice #", ""]) + card(False, sep)

    def phone(good: bool) -> str:
        sep = rng.choice(" .-")
        if not good:
            return rng.choice([f"{rng.choice(['order ', 'isbn ', 'ref ', 'sku ', w() + ' '])}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"{rng.choice(['lot ', 'part ', w() + ' '])}00{rng.randint(1, 9)}{d(2)} {d(3)} {d(3)}", f"{rng.choice(['serial ', 'case '])}0{rng.randint(1, 9)}{d(2)}-{d(3)}-{d(2)}"])
        lead = rng.choice(["call ", "phone: ", "tel ", "contact me at ", "fax "])
        return lead + rng.choice([f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{rng.randint(1, 99)} {d(3)} {d(3)} {d(3)}", f"0{rng.randint(1, 9)}{d(2)}/{d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)} {d(4)} {d(4)}"])

    def secret(good: bool) -> str:
        name = rng.choice(["password", "passwd", "secret", "token", "api_key", "access key", "auth"])
        tie = rng.choice(["=", " = ", ": ", ":", " is ", ' = "'])
        if good:
            value = rng.choice([any_of(hexed, rng.choice([16, 18, 20, 32, 40])), any_of(mixed, rng.randint(16, 40)), w() + d(3) + any_of(mixed, 8)])
            return rng.choice([f"{name}{tie}{value}", "AKIA" + any_of(mixed[:26] + mixed[52:], 16), "ghp_" + any_of(mixed, 36), f"{name} {tie.strip()} {any_of(hexed, 40)}"])
        long = "-".join(w() for _ in range(9))
        return rng.choice([f"{name}{tie}{w()}{w()}{w()}", f"{name} {rng.choice(['required', 'management', 'protected', 'exchange', 'authenticated'])}", f"commit {any_of(hexed, 40)}", f"sha {any_of(hexed, 64)}", long, "/".join(w() for _ in range(8)), "-" * 40])

    made = {"email": email, "ip": ip, "card": number, "phone": phone, "secret": secret}
    out = []
    for k in range(n):
        for kind in ADDED:
            window = rng.choice(windows)
            cut = rng.randint(0, len(window))
            good = k % 2
            out.append((kind, f"{window[:cut].rstrip()} {made[kind](bool(good))}{rng.choice(['.', ' ', ',', chr(10)])}{window[cut:].lstrip()}", good))
    return out


Model = tuple[Trees, dict[str, float]]


def model(docs: DataFrame) -> Model:
    """Trees, and for each kind the least score from which PRECISION of the examples kept for calibration are right.

    An example's own candidates carry its label; others that generators find in its window count as wrong.
    """
    x, y, kinds, fold = [], [], [], []
    for i, (kind, text, label) in enumerate(_examples(_windows(docs))):
        for g, pattern in enumerate(_COMPILED[kind]):
            for m in pattern.finditer(text):
                end = _ENDS[kind, g].search(m[0]) if (kind, g) in _ENDS else None
                if (kind, g) in _ENDS and not end:
                    continue
                start = m.start() + (end.start() if end else 0)
                f = plain_features(kind, g, text[start : m.end()], text[max(0, start - NEAR) : start])
                # Of a card's chain or an address only what passes the check is right.
                good = label and (kind != "card" or f[6] == 1) and not (kind == "ip" and g == 0 and f[11] == 0)
                x.append(f)
                y.append(float(good))
                kinds.append(kind)
                fold.append(i // len(ADDED) // 2 % 3)
    x, y, kinds, fold = np.array(x), np.array(y, float), np.array(kinds), np.array(fold)
    trees = Trees().fit(x[fold != 0], y[fold != 0])
    return trees, {k: _threshold(trees.score(x[(kinds == k) & (fold == 0)]), y[(kinds == k) & (fold == 0)]) for k in ADDED}


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The least score with PRECISION at and above it, half way to the next one below; above every score if there is none."""
    order = np.argsort(-score, kind="stable")
    s, right = score[order], np.cumsum(y[order])
    last = np.flatnonzero((right >= PRECISION * np.arange(1, len(s) + 1)) & np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, int)
    if not len(last):
        return 2.0
    k = int(last[-1])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,score:double>>"


def _proposed(text: Column, kind: str, fitted: Model) -> list[Column]:
    """Each generator's candidates above the kind's threshold."""
    trees, least = fitted

    def scored(g: int) -> Column:
        value = lambda m: let(F.array(*features(kind, g, m)), lambda xs: trees.column([xs[j] for j in range(len(features(kind, g, m)))]))
        spans = F.transform(candidates(text, kind, g), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(ADDED.index(kind)).alias("kind"), value(m).alias("score")))
        return F.filter(spans, lambda s: s["score"] >= least[kind])

    return [F.when(_tried(text, kind, g), scored(g)).otherwise(F.expr(f"cast(array() as {_SPAN})")) for g in range(len(GENERATORS[kind]))]


def _chosen(spans: Column, taken: Column) -> Column:
    """Of the candidates that overlap no base span, and of those that overlap one another the longest of one kind, the best of several."""
    free = F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        longer = s["end"] - s["start"] > last["end"] - last["start"]
        better = F.when(s["kind"] == last["kind"], longer).otherwise((s["score"] > last["score"]) | ((s["score"] == last["score"]) & longer))
        one = F.array(s)
        return F.when((F.size(kept) == 0) | F.coalesce(last["end"] <= s["start"], F.lit(True)), F.concat(kept, one)).when(better, F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), one)).otherwise(kept)

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(F.array_sort(free), F.expr(f"cast(array() as {_SPAN})"), step))


def detect(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """``docs`` with a column ``pii``: for each kind its base spans and the added ones, each start and end in code points.

    Null and empty texts have none.  An added span overlaps no base span and no other
    added one; secrets are added ones only.  Other columns pass through; one named
    ``pii`` is replaced.  Without ``fitted`` the model is made from ``docs``.
    """
    fitted = fitted or model(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda ms: F.transform(ms, lambda m: F.struct(m["start"], m["end"]))
    proposed = reduce(F.concat, [c for k in ADDED for c in _proposed(text, k, fitted)])
    out = docs.drop("pii").withColumn("pii", F.struct(*[plain(base_spans(text, k)).alias(k) for k in KINDS], proposed.alias("proposed")))
    taken = F.concat(*[F.col(f"pii.{k}") for k in KINDS])
    out = out.withColumn("pii", F.struct(*[F.col(f"pii.{k}").alias(k) for k in KINDS], _chosen(F.col("pii.proposed"), taken).alias("added")))
    of = lambda k: plain(F.filter("pii.added", lambda s: s["kind"] == ADDED.index(k)))
    return out.withColumn("pii", F.struct(*[F.col(f"pii.{k}").alias(k) for k in KINDS], *[of(k).alias(f"added_{k}") for k in ADDED]))


def redact(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``detect`` in ``text`` replaced by its kind in brackets, all in one pass.

    Spans that overlap are masked as one, under the kind of the first (of equal starts
    the longest), so no character of any span stays.  Null texts stay null.
    """
    kinds = [*((k, k) for k in KINDS), *((f"added_{k}", k) for k in ADDED)]
    tagged = lambda c, tag: F.transform(f"pii.{c}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), F.lit(tag).alias("tag")))
    every = F.concat(*[tagged(c, f"[{k.upper()}]") for c, k in kinds])
    merged_type = "array<struct<start:bigint,end:bigint,tag:string>>"

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        new = F.array(F.struct(s["start"].alias("start"), (-s["to"]).alias("end"), s["tag"].alias("tag")))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], -s["to"]).alias("end"), last["tag"].alias("tag")))
        return F.when((F.size(kept) == 0) | F.coalesce(last["end"] <= s["start"], F.lit(True)), F.concat(kept, new)).otherwise(F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), wider))

    def masked(spans: Column) -> Column:
        before = lambda i: F.when(i > 0, spans[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(F.lit(0).cast("long"))
        piece = F.transform(spans, lambda s, i: F.concat(F.substr("text", (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), s["tag"]))
        return F.concat(F.array_join(piece, ""), F.substr("text", (F.element_at(spans, -1)["end"] + 1).cast("int")))

    found = detect(docs, fitted).withColumn("pii", F.aggregate(F.array_sort(every), F.expr(f"cast(array() as {merged_type})"), step))
    out = found.withColumn("text", F.when(F.size("pii") > 0, let(F.col("pii"), masked)).otherwise(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    said = lambda kind, ms: F.transform(ms, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))
    both = F.concat(*[said(k, F.array_sort(F.concat(F.col(f"pii.{k}"), F.col(f"pii.added_{k}")))) for k in KINDS], said("secret", F.array_sort(F.col("pii.added_secret"))))
    base = F.concat(*[said(k, F.col(f"pii.{k}")) for k in KINDS])
    added = sum((F.size(f"pii.added_{k}") for k in ADDED[1:]), F.size(f"pii.added_{ADDED[0]}"))
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(both, ",").alias("spans"), added.cast("long").alias("n_added"), F.size(both).cast("long").alias("n_found"))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
