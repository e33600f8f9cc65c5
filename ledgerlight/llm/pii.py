"""Personal data by candidate gradient boosting.

Spans that follow a strict format (an e-mail address, four numbers up to 255, a card number that passes Luhn's test,
a + and 9 to 15 digits) are found by rule and always kept. Beyond them, generators of high recall propose further
spans, overlapping ones too: disguised addresses, national phone numbers, card numbers with other separators,
addresses with ports. Boosted trees score each proposal by its format and its context; scores are calibrated, and
each kind has the lowest threshold that held PRECISION on examples left out of the training. Of overlapping proposals
the best one stays; none may overlap a span found by rule.

There are no labelled rows for this, so the trees learn from examples that are written here by a seeded grammar of
formats and contexts, personal and not.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Of candidates that tie in score the one
that begins first and is longest stays. Repeated rows are treated each for itself; extra columns are not read. A text is
searched whole, however long; time grows with its length, not with the square of its spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Trees, platt
from .segments import slices, trim
from .store import by_bytes

KINDS = ("email", "ip", "card", "phone")
#: Precision that each kind's added spans shall have on examples left out of the training.
PRECISION = 0.99
#: Code points of context on each side of a candidate that features see.
CONTEXT = 32
#: Candidates that are scored at once.
SCORED = 4096
#: Bytes of text that are searched at once.
AT_ONCE = 1 << 20

# The fixed formats. Possessive digits and the look-behinds change no match, but keep long runs of digits linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]| dot ")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans by rule: leftmost and non-overlapping for each kind, failing matches dropped."""
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: (kind, trigger that a text must hold, pattern); every repetition is bounded, so that each is linear.
GENERATORS = (
    ("email", re.compile(r"[(\[{] ?at ?[)\]}]| at .{1,40} dot "), re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:[(\[{] ?at ?[)\]}]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?dot ?[)\]}]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("phone", re.compile(r"[0-9]{3}"), re.compile(r"(?<![0-9A-Za-z])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"[0-9]{7}"), re.compile(r"(?<![0-9A-Za-z])[0-9]{9,11}(?![0-9A-Za-z])")),
    ("card", re.compile(r"[0-9]{3}"), re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"[0-9]\.[0-9]|:[0-9a-fA-F]{0,4}:"), re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){1,5}::[0-9a-fA-F]{1,4})(?![0-9A-Za-z.:])")),
)

# Words in the context that speak for a kind, and those that speak for another sense of a number.
_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|dial|whatsapp|sms)"),
    "card": re.compile(r"(?i)\b(?:card|visa|master|amex|credit|debit|pay)"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|login|connect|client|addr)"),
}
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|isbn|issn|version|page|part|serial|ref|item|model|section|chapter|total|pp?\.|no\.|#)")


def candidates(text: str) -> list[tuple[int, str, int, int]]:
    """(generator, kind, start, end), overlapping ones too."""
    return [(k, kind, *m.span()) for k, (kind, trigger, pattern) in enumerate(GENERATORS) if trigger.search(text) for m in pattern.finditer(text)]


def features(text: str, g: int, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    seps = re.findall(r"[^0-9A-Za-z]+", span)
    wanted, other = list(_FOR[kind].finditer(before)), list(_AGAINST.finditer(before))
    return [
        *[float(g == k) for k in range(len(GENERATORS))],
        len(span), len(digits), len(groups), len(set(seps)), len(seps),
        *[float(len(groups[k])) if k < len(groups) else 0.0 for k in range(4)],
        float(len(groups[-1])) if groups else 0.0,
        float("(" in span), float(digits[:2] == "00"), float(digits[:2] in ("19", "20")),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(bool(groups) and all(map(_small, groups))),
        sum(c in "([{" for c in span), span.count("."), span.count("/"), span.count(":"), span.count("-"),
        float(" dot " in span or "dot" in span), float(" at " in span),
        float(wanted[-1].end() - len(before) if wanted else -99.0), float(other[-1].end() - len(before) if other else -99.0),
        float(bool(_FOR[kind].search(after))), float(before[-1:] in ("$", "#", "€", "£", ":")), float(after[:1] in ("%", "$", "€")),
        float(sum(c.isdigit() for c in before[-6:])), float(sum(c.isdigit() for c in after[:6])),
    ]


def _example(rng: np.random.Generator) -> tuple[str, str, bool]:
    """A text, the kind of number or address it holds, and whether it is personal."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(("ta", "re", "on", "li", "mo", "ser", "an", "di")) for _ in range(rng.integers(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    kind, yes = pick(KINDS), bool(rng.random() < 0.5)
    sep = pick((" ", "-", "."))
    if kind == "email":
        at, dot = pick(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), ("(at)", ".")))
        body = f"{word()}{pick(('', '.' + word(), num(2)))}{at}{word()}{dot}{pick(('com', 'org', 'net', 'de', 'fr', 'io'))}"
        if not yes:
            body = pick((f"{word()} at {word()}. {word()}", f"{word()} at the dot {word()}", f"meet at {num(1)} dot {num(2)}", f"{word()} at {word()} dot {word()} {word()}", f"{word()} (at) {word()}.{num(2)}"))
        lead = pick(("e-mail: ", "contact ", "write to ", "", "mail ")) if yes else pick(("look ", "stay ", "", "arrive "))
    elif kind == "phone":
        lead = pick(("call ", "phone: ", "tel. ", "mobile ", "fax: ", "my cell is ")) if yes else pick(("order ", "invoice no. ", "isbn ", "", "part ", "ref ", "total ", "page ", "serial "))
        body = pick((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"00{pick(('44', '49', '33', '34'))} {num(3)} {num(4)} {num(2)}", f"0{num(3)}/{num(3)} {num(4)}", f"0{num(9)}"))
        if yes and rng.random() < 0.3:
            lead, body = "", f"({num(3)}) {num(3)}-{num(4)}"
        elif not yes:
            body = pick((f"{num(4)}-{num(2)}-{num(2)}", f"20{num(2)}-{num(2)}-{num(2)} {num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(3)}", f"{num(10)}", f"{num(2)}/{num(2)}/{num(4)}", body))
    elif kind == "card":
        digits = num(15)
        check = next(str(d) for d in range(10) if luhn(digits + str(d)) == yes)
        digits += check
        glue = pick((".", "_", "/", "  ", " - ")) if yes else pick((" ", "-", ".", "/"))
        body = glue.join(digits[k : k + 4] for k in range(0, 16, 4)).replace(" - ", "- ")
        lead = pick(("card ", "visa ", "paid by credit card ", "amex: ", "")) if yes else pick(("order ", "serial ", "", "part no. ", "ref "))
    else:
        v4 = ".".join(str(d) for d in rng.integers(1, 256, 4))
        v6 = ":".join(f"{d:x}" for d in rng.integers(0, 65536, 8))
        body = pick((f"{v4}:{rng.integers(1, 65536)}", v6)) if yes else pick((f"{rng.integers(256, 999)}.{num(3)}.{num(2)}.{num(3)}:{num(2)}", ":".join(num(2) for _ in range(8))))
        lead = pick(("host ", "login from ", "ip ", "")) if yes else pick(("at ", "version ", "section ", ""))
    return f"{prose(rng.integers(0, 6))} {lead}{body}{pick((' ', ', ', '. ', ''))}{prose(rng.integers(0, 5))}", kind, yes


class Taken:
    """Spans in the order of their starts, with what is covered as separate runs, so that a look-up is a bisection."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, z: int) -> bool:
        k = bisect.bisect_left(self.starts, z)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, z: int) -> None:
        k = bisect.bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a:  # spans by rule may overlap each other: they become one run
            self.ends[k - 1] = max(self.ends[k - 1], z)
        else:
            self.starts.insert(k, a)
            self.ends.insert(k, z)


class Model:
    def __init__(self, examples: int = 6000, seed: int = 5):
        rng = np.random.default_rng(seed)
        x, y, kinds, aside = [], [], [], []
        for _ in range(examples):
            text, kind, yes = _example(rng)
            side = rng.random() < 0.25
            base = base_spans(text)
            for g, k, a, z in candidates(text):
                if not any(a < e and s < z for _, s, e in base):
                    x.append(features(text, g, k, a, z))
                    y.append(float(yes and k == kind))
                    kinds.append(KINDS.index(k))
                    aside.append(side)
        x, y, kinds, aside = np.array(x), np.array(y), np.array(kinds), np.array(aside)
        self.trees = Trees().fit(x[~aside], y[~aside])
        z = self.trees.raw(x[aside])
        self.slope, self.shift = platt(z, y[aside])
        p = self._calibrated(z)
        self.thresholds = {}
        for k, kind in enumerate(KINDS):
            mine = kinds[aside] == k
            order = np.argsort(-p[mine], kind="stable")
            right = np.cumsum(y[aside][mine][order]) / np.arange(1, mine.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            self.thresholds[kind] = max(0.9, float(p[mine][order][good[-1]])) if len(good) else 2.0

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Proposals that pass their kind's threshold, the best of overlapping ones."""
        taken = Taken()
        for _, a, z in sorted(base, key=lambda s: s[1]):
            taken.add(a, z)
        found = [c for c in candidates(text) if taken.free(c[2], c[3])]
        scores: list[float] = []
        for k in range(0, len(found), SCORED):
            scores += self._calibrated(self.trees.raw(np.array([features(text, *c) for c in found[k : k + SCORED]]))).tolist()
        out: list[Span] = []
        for score, (_, kind, a, z) in sorted(zip(scores, found, strict=True), key=lambda c: (-c[0], c[1][2], -c[1][3])):
            if score >= self.thresholds[kind] and taken.free(a, z):
                taken.add(a, z)
                out.append((kind, a, z))
        return out

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        if not text or not _ANY.search(text):
            return [], []
        base = base_spans(text)
        return base, base + self.added(text, base)


@lru_cache(1)
def model() -> Model:
    """Trained once in a process; every process trains the same one."""
    return Model()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans by rule for each kind, the digest of their list, and the list of all spans."""
    trained = model()

    def run(batches):
        for whole in batches:
            for a, z in slices(whole.column(1), AT_ONCE):
                yield found(whole.slice(a, z - a))
            trim()

    def found(b):
        base, every = zip(*map(trained.spans, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
        counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
        digest = [hashlib.sha256(listed(x).encode()).hexdigest() for x in base]
        return pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(listed, every), pa.string())], names=[x.split()[0] for x in FOUND.split(", ")])

    return by_bytes(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced; n_chars, if there is such a column, follows. No column but text leaves the
    JVM; the others pass through."""
    trained = model()

    def replaced(texts: pa.Array) -> pa.Array:
        # null where nothing is replaced, so that no text is sent back as it came
        out: list[str | None] = []
        for a, z in slices(texts, AT_ONCE):
            out += [redacted(t, s) if (s := trained.spans(t)[1]) else None for t in texts.slice(a, z - a).to_pylist()]
        trim()
        return pa.array(out, pa.string())

    new = F.arrow_udf(replaced, "string")(F.col("text").cast("string"))
    name = "_redacted"
    while name in docs.columns:
        name += "_"
    marked = by_bytes(docs).withColumn(name, new)
    n_chars = lambda kind: F.when(F.col(name).isNotNull(), F.length(name).cast(kind)).otherwise(F.col("n_chars"))
    cols = {"text": F.coalesce(F.col(name), F.col("text"))} | {c: n_chars(t) for c, t in docs.dtypes if c == "n_chars"}
    return marked.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])
