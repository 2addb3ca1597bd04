"""Personal data: generators propose spans, boosted trees judge them, thresholds select them."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Columns, map_columns, stored

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- Base spans: fixed formats, always redacted ------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by kind as listed, then start; linear in the text's length."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text)
                if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- Candidates: overlapping spans in looser formats -------------------------------------

_AT, _DOT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\s?@\s?|\sat\s)", r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\.|\sdot\s)"
_EMAILISH = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_EMAIL_SIGN = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sdot\s|[\[({]\s?dot\s?[\])}]", re.I)
_IPISH = re.compile(
    r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.)\s?[0-9]{1,3}){3}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARDISH = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ./ -]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")
_PHONISH = re.compile(
    r"(?<![0-9A-Za-z.])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:[0-9][ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})"
    r"(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_GROUPS = re.compile(r"[0-9]+")

# Words that come before personal data, in the languages of the documents.
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|correo|courriel|contact|write|schreib\w*)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|adresse|direcci[oó]n)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|carte|karte|tarjeta|pay\w*)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|whatsapp|telefon\w*|t[eé]l\w*|llam\w*)\b", re.I),
}
_NOT = re.compile(r"\b(?:version|license|licence|token|key|hash|id|isbn|page|chapter|v)\W*\Z", re.I)

FEATURES = (
    "email", "ip", "card", "phone", "length", "digits", "letters", "groups", "longest_group",
    "shortest_group", "distinct_digits", "luhn", "octets", "plus", "brackets", "dots", "dashes",
    "spaces", "disguise", "before_alnum", "after_alnum", "before_sign", "after_sign", "quoted",
    "cue", "other_cue", "not_cue", "leading_zero", "first_group",
)


def candidates(text: str) -> list[Span]:
    """Spans in looser formats; those of one kind do not overlap, those of two may."""
    out: list[Span] = []
    last = 0
    for sign in _EMAIL_SIGN.finditer(text):
        lo = max(last, sign.start() - 100)
        for m in _EMAILISH.finditer(text, lo, min(len(text), sign.end() + 200)):
            out.append(("email", *m.span()))
            last = m.end()
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IPISH.finditer(text)]
        out += [("card", *m.span()) for m in _CARDISH.finditer(text)]
        out += [("phone", *m.span()) for m in _PHONISH.finditer(text)
                if 9 <= len(_digits(m.group())) <= 15]
    return sorted(set(out), key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context, as in ``FEATURES``."""
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 40):start], text[end:end + 2]
    digits, groups = _digits(s), _GROUPS.findall(s)
    sizes = [len(g) for g in groups] or [0]
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)
    return [float(x) for x in (
        kind == "email", kind == "ip", kind == "card", kind == "phone", len(s), len(digits),
        sum(c.isalpha() for c in s), len(groups), max(sizes), min(sizes), len(set(digits)),
        bool(digits) and luhn(digits), octets, "+" in s, s.count("(") + s.count("["), s.count("."),
        s.count("-"), s.count(" "), bool(_EMAIL_SIGN.search(s)), before[-1:].isalnum(),
        after[:1].isalnum(), before[-1:] in "#$%*&/=", after[:1] in "#$%*&/=", before[-1:] in "\"'",
        bool(CUES[kind].search(before)), any(c.search(before) for k, c in CUES.items() if k != kind),
        bool(_NOT.search(before)), digits[:1] == "0", sizes[0],
    )]


# ---- Training rows: the documents' own base spans, and what is made of them ----------------


def _variants(kind: str, s: str, rng: random.Random) -> tuple[str, str]:
    """The same data in a looser format, and a look-alike that is not personal data."""
    if kind == "email":
        local, domain = s.rsplit("@", 1)
        at, dot = rng.choice([(" [at] ", "."), (" (at) ", " (dot) "), (" @ ", "."), (" at ", " dot "),
                              ("[at]", "[dot]")])
        return local + at + domain.replace(".", dot), rng.choice(
            [f"{local} at {domain.split('.')[0]}", f"@{local}", f"{local} dot {domain.split('.')[-1]} dot"])
    if kind == "ip":
        dot = rng.choice(["[.]", "(.)", " . "])
        parts = s.split(".")
        return s.replace(".", dot), rng.choice(
            [".".join(str(int(p) + 300)[:3] for p in parts), ".".join(parts[:2]), ".".join(parts + ["7"])])
    digits = _digits(s)
    if kind == "card":
        sign = rng.choice([".", "/", "  ", " "])
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4)), rng.choice(
            [wrong, " ".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), digits + digits[:4] + "x"])
    area, a, b = digits[-10:-7], digits[-7:-4], digits[-4:]
    year, day = 1900 + int(b) % 130, f"{1 + int(a) % 28:02d}"
    return (
        rng.choice([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"00{digits[:-10] or 1} {area} {a} {b}"]),
        rng.choice([f"{year}-05-{day} 10:{day}", f"{year}-05-{day}-{day}", f"{day}.05.{year}", f"{a},{b}.00",
                    f"{year}-{year + 1}", f"{digits}{digits}", f"{digits[:9]}", f"{a}{b} {day}"]),
    )


def training_rows(text: str, seed: int) -> list[tuple[list[float], float, int]]:
    """``(features, label, kind number)`` from one text's base spans.

    Positive: a base span, and the same data rewritten in a looser format where it stood.
    Negative: look-alikes put in its place, and candidates beside any base span.
    """
    rng, out = random.Random(seed), []

    def add(t: str, spans: list[Span], label: float) -> None:
        out.extend((features(t, s), label, KINDS.index(s[0])) for s in spans)

    base = base_spans(text)
    for kind, start, end in base:
        lo = max(0, start - 60)
        left, right = text[lo:start], text[end:end + 60]
        add(left + text[start:end] + right, [(kind, start - lo, end - lo)], 1.0)
        loose, alike = _variants(kind, text[start:end], rng)
        for new, label in ((loose, 1.0), (alike, 0.0)):
            t, a, b = left + new + right, start - lo, start - lo + len(new)
            for span in candidates(t):
                exact = span == (kind, a, b)
                if exact or (label == 0.0 and span[1] < b and span[2] > a):
                    add(t, [span], label)
                elif span[1] < b and span[2] > a:
                    add(t, [span], 0.0)  # another kind or another cut of the same place
    beside = [c for c in candidates(text) if not any(c[1] < e and c[2] > s for _, s, e in base)]
    add(text, beside, 0.0)
    return out


def _trees(model) -> list[tuple]:
    """The fitted trees as nested ``(feature, threshold, left, right)`` with numbers as leaves."""
    def walk(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return (split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(t._call_java("rootNode")) for t in model.trees]


def _margin(trees: list[tuple], weights: list[float], x: list[float]) -> float:
    total = 0.0
    for tree, weight in zip(trees, weights):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        total += weight * tree
    return total


class Judge:
    """Boosted trees and, for each kind, the least margin that selects a span."""

    def __init__(self, trees: list[tuple], weights: list[float], least: dict[str, float]):
        self.trees, self.weights, self.least = trees, weights, least

    def margin(self, x: list[float]) -> float:
        return _margin(self.trees, self.weights, x)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that do not overlap base spans; of two that overlap, the surer."""
        found = []
        for c in candidates(text):
            if not any(c[1] < e and c[2] > s for _, s, e in base):
                margin = self.margin(features(text, c))
                if margin >= self.least.get(c[0], float("inf")):
                    found.append((-margin, c))
        out: list[Span] = []
        for _, c in sorted(found):
            if not any(c[1] < e and c[2] > s for _, s, e in out):
                out.append(c)
        return out


def learn_judge(
    texts: DataFrame, precision: float = 0.98, trees: int = 20, depth: int = 4,
) -> Judge | None:
    """Trees fitted on all documents (column ``text``) with a digit or an @.

    A quarter of the training rows is kept from the trees; on it, each kind gets the least margin
    from which on at least ``precision`` of the rows are personal data (a kind without such a
    margin adds no spans). Without both labels there is no judge. The rows stay in the tasks: only
    the trees and a margin for each kind come to the driver.
    """
    sample = texts.where(F.col("text").rlike("[0-9@]")).select("text")

    def prepare():
        def run(c: Columns) -> Columns:
            rows = []
            for text in c["text"]:
                seed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest())
                rows += [(*r, (seed + i) % 4 == 0) for i, r in enumerate(training_rows(text, seed))]
            return dict(zip(("x", "label", "kind", "held"), zip(*rows))) if rows else {
                "x": [], "label": [], "kind": [], "held": []}
        return run

    rows = stored(map_columns(
        sample, "x array<double>, label double, kind int, held boolean", prepare), "candidates")
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    if not all(counts.get((label, False)) for label in (0.0, 1.0)):
        return None
    train = rows.where("not held").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, minInstancesPerNode=3,
                          checkpointInterval=-1).fit(train)
    tables, weights = _trees(model), list(model.treeWeights)

    def prepare_margins():
        def run(c: Columns) -> Columns:
            return {"kind": c["kind"], "label": c["label"], "margin": [_margin(tables, weights, x) for x in c["x"]]}
        return run

    held = map_columns(rows.where("held").select("x", "kind", "label"),
                       "kind int, label double, margin double", prepare_margins)
    sums = held.groupBy("kind", "margin").agg(F.sum("label").alias("good"), F.count("*").alias("total"))
    from_here = Window.partitionBy("kind").orderBy(F.col("margin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    good, total = F.sum("good").over(from_here), F.sum("total").over(from_here)
    precise = sums.select("kind", "margin", (good >= precision * total).alias("precise")).where("precise and margin > 0")
    least = {KINDS[r["kind"]]: r["least"] for r in precise.groupBy("kind").agg(F.min("margin").alias("least")).collect()}
    return Judge(tables, weights, least)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, base, added, redacted)`` for every row of ``docs``.

    ``base`` and ``added`` are arrays of ``(kind, start, end)`` in code points, end exclusive;
    ``redacted`` is the text with each span replaced by its kind in brackets. Base spans are
    those of the fixed formats and are never dropped; added spans never overlap them.

    A null or empty text has no spans. Texts of any length are read whole. Repeated rows get a
    row each, and so do null ids. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    judge = learn_judge(texts)

    def prepare():
        def run(c: Columns) -> Columns:
            out: Columns = {"id": c["id"], "base": [], "added": [], "redacted": []}
            for text in c["text"]:
                base = base_spans(text)
                added = judge.added(text, base) if judge else []
                out["base"].append([dict(zip(("kind", "start", "end"), s)) for s in base])
                out["added"].append([dict(zip(("kind", "start", "end"), s)) for s in sorted(added, key=_order)])
                out["redacted"].append(redact(text, base + added))
            return out
        return run

    spans = "array<struct<kind: string, start: long, end: long>>"
    kind = texts.schema["id"].dataType.simpleString()
    return map_columns(texts, f"id {kind}, base {spans}, added {spans}, redacted string", prepare)


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind; where spans overlap, from the first start to the last end."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
