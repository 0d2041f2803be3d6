"""Secret scan: fixed patterns, and strings that two character Markov models call random.

One order-1 model is trained on labelled random strings and one on labelled ordinary identifiers.  A
candidate is a run of identifier or base64 characters outside the spans of the patterns, at least ``shortest``
long.  Each of its stretches whose log-likelihood ratio passes a threshold, set on held-back labelled samples, is
a secret, however ordinary what surrounds it in the run: the ratio is added up along the run, begins anew where
that is better, and a stretch ends where the sum has fallen by the threshold.  A stretch is widened to whole
letters-and-digits words.  The models add spans of kind ``markov``; those of the patterns always stay.

Results that are defined: a null text counts as empty and has no spans; equal rows give equal results;
offsets are code points, ends exclusive; the time for a text of any length grows in proportion to it; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quern.llm.common import map_text, narrow

KINDS = ("assign", "access", "hex", "markov")
#: ASCII folding alone: under Unicode rules "k" would match U+212A and "s" U+017F.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs and secrets of fewer characters are too short to tell.
SHORTEST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
RANDOM_ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
PARTS = (
    "access account action address agent album api app archive array author average background base batch block body book border "
    "branch browser buffer build button cache call camera category change channel check city class client code column command "
    "comment compare config connection container content context control count country create current data date default delete "
    "der die document domain editor element else en error event example export factory feature file filter format forward "
    "frame from function get group handler header height history home host image import index info input instance interface "
    "item java join key label language last layout length level library line link list load local log main manager map "
    "market member menu message method model module month name network node number object option order output page panel "
    "parameter parent parser partner path pattern payment people phone picture place player plugin point position post "
    "price print process product profile project property provider public query question read record region register "
    "release remote report request resource response result return role root route row sample scale schema school screen "
    "script search section select server service session set settings shop site size source space standard start state "
    "static status storage stream street string student style support system table target task template test text theme "
    "thread time title token tool total track transfer type update upload url user value version video view website "
    "week widget width window word work world year zone "
    "aber achtung arbeit aufgabe beziehung deutsch einheit entwicklung freiheit gesellschaft heute keit lich möglich nicht schaft "
    "ung verein wissenschaft zeit zusammen aujourd avec beaucoup chaque développement eau eaux entreprise être eux jour lettre "
    "mentalité oiseau pays quelque question toujours travail vie ahora ciudad desarrollo donde gobierno hacia mundo nación "
    "nosotros palabra pueblo siempre tiempo trabajo universidad vida "
    "qwerty asdf zxcv hjkl xyzzy plugh foo bar baz qux lorem ipsum"
).split()
#: Short technical words, with or without numbers.
TECHNICAL = (
    "f fp bf int uint utf sha md aes rsa gfx rdna cdna mfma avx sse x86 arm amd nv sm cu h264 mp3 ip ipv tcp udp http tls ssl ssh "
    "k v x y z n m id idx ptr buf cfg ctx src dst tmp str num len max min avg std fft gpu cpu ram ssd nvme usb pci rev ver qty px dpi ghz khz mb gb"
).split()


def samples(label: int, n: int, seed: int) -> list[str]:
    """Labelled strings: 1 random ones over common alphabets, 0 identifiers, paths, dates and numbers."""
    rng = random.Random(f"{label}:{seed}")
    if label:
        return ["".join(rng.choices(rng.choice(RANDOM_ALPHABETS), k=rng.randint(16, 64))) for _ in range(n)]
    out = []
    for _ in range(n):
        words = rng.choices(PARTS, k=rng.randint(2, 7))
        style = rng.randrange(12)
        if style == 8:
            out.append("".join(rng.choices("0123456789", k=rng.randint(12, 20))))
            continue
        if style == 11:  # lines and fillers
            out.append(rng.choice(ALPHABET) * rng.randint(8, 60))
            continue
        if style > 8:
            parts = [rng.choice(TECHNICAL) + rng.choice(("", "", str(rng.randint(0, 9)), str(1 << rng.randint(1, 12)), str(rng.randint(10, 2000)))) for _ in range(rng.randint(3, 8))]
            parts = [x if rng.random() < 0.8 else "x".join(str(1 << rng.randint(0, 8)) for _ in range(rng.randint(2, 3))) for x in parts]
            parts = [x if rng.random() < 0.7 else rng.choice(PARTS) for x in parts]
            out.append(rng.choice("__--./").join(parts) if style == 9 else "_".join(parts).upper())
            continue
        if style == 0:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 1:
            text = "".join(w.capitalize() for w in words)
        elif style in (2, 3):
            text = "_".join(words)
        elif style == 4:
            text = "-".join(words)
        elif style == 5:
            text = "/".join(words) + rng.choice(("", ".html", ".py", ".json"))
        elif style == 6:
            text = "_".join(words).upper()
        else:
            text = "".join(words)
        if rng.random() < 0.3:
            text += rng.choice(("", "_", "-", "/")) + rng.choice((str(rng.randint(0, 2030)), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", "v" + str(rng.randint(1, 9))))
        out.append(text)
    return out


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of the first character and of each transition, and the threshold."""

    first: np.ndarray
    step: np.ndarray
    threshold: float

    def ratio(self, text: str) -> float:
        code = _codes(text)
        return float(self.first[code[0]] + self.step[code[:-1], code[1:]].sum()) if len(code) else 0.0

    def best(self, text: str) -> float:
        """The ratio of the best stretch of a string."""
        code = _codes(text)
        if not len(code):
            return 0.0
        sums = np.concatenate([[0.0], np.cumsum(self.step[code[:-1], code[1:]])])
        return float((sums - np.minimum.accumulate(sums - self.first[code])).max())

    def stretches(self, text: str, shortest: int = SHORTEST) -> list[tuple[int, int, float]]:
        """(start, end, ratio) of the secrets in a run of characters of the alphabet."""
        if len(text) < shortest or self.best(text) <= self.threshold:
            return []
        code = _codes(text)
        first, step = self.first[code].tolist(), [0.0, *self.step[code[:-1], code[1:]].tolist()]
        found: list[tuple[int, int, float]] = []
        start, end, at, total, best = 0, 1, 0, first[0], first[0]
        while True:
            at += 1
            over = at == len(code)
            if not over:
                total += step[at]
            if over or total < best - self.threshold or best <= self.threshold and total <= first[at]:
                if best > self.threshold:
                    found.append((start, end, best))
                    over, at = end == len(code), end  # what follows the stretch may begin another
                if over:
                    break
                start, end, total, best = at, at + 1, first[at], first[at]
            elif total > best:
                best, end = total, at + 1
        wide: list[tuple[int, int, float]] = []
        for a, b, ratio in found:
            while a and text[a - 1].isalnum() and text[a].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            while a < b and text[a] in "/._-=+":
                a += 1
            while a < b and text[b - 1] in "/._-":
                b -= 1
            if wide and a < wide[-1][1]:
                a, ratio = wide[-1][0], ratio + wide.pop()[2]
            wide.append((a, b, ratio))
        known = [m.span() for m in _UUID.finditer(text)]
        out = []
        for a, b, ratio in wide:
            parts = _varied(text, a, b)
            for c, d in parts:
                own = ratio if (c, d) == (a, b) else self.best(text[c:d])
                if d - c >= shortest and own > self.threshold and not any(x <= c and d <= y for x, y in known):
                    out.append((c, d, own))
        return out


#: Identifiers that are random by design and no secrets.
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
#: A pair of characters comes back if it stood so few places before; so many of these in a row are filler.
AGAIN, FILLER = 64, 12


def _varied(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The parts of text[a:b] without fillers such as ``=-=-``, in which at most half of the pairs come back."""
    last: dict[str, int] = {}
    again = []
    for i in range(a, b - 1):
        pair = text[i : i + 2]
        again.append(i - last.get(pair, i - AGAIN - 1) <= AGAIN)
        last[pair] = i
    parts, begin, run = [], a, 0
    for i, back in enumerate([*again, False]):
        if back:
            run += 1
            continue
        if run >= FILLER:  # the pairs i - run ... i - 1 came back
            parts.append((begin, a + i - run + 1))
            begin = a + i
        run = 0
    parts.append((begin, b))
    out = []
    for c, d in parts:
        while c < d and text[c] in "/._-=+" and c > a:
            c += 1
        while c < d and text[d - 1] in "/._-" and d < b:
            d -= 1
        if d > c and 2 * sum(again[c - a : d - a - 1]) <= d - c - 1:
            out.append((c, d))
    return out


_CODE = np.full(128, len(ALPHABET) - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def _chain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log probabilities of first characters and transitions."""
    size = len(ALPHABET)
    first, step = np.full(size, 0.5), np.zeros((size, size))
    for text in texts:
        code = _codes(text)
        first[code[0]] += 1
        np.add.at(step, (code[:-1], code[1:]), 1)
    overall = (step.sum(axis=0) + 0.5) / (step.sum() + 0.5 * size)
    step = (step + 10 * overall) / (step.sum(axis=1, keepdims=True) + 10)
    return np.log(first / first.sum()), np.log(step)


def train(random_strings: list[str], ordinary: list[str], held_random: list[str], held_ordinary: list[str], rate: float = 1e-3) -> Model:
    """Models from labelled samples.

    The threshold lies midway between the ratios that the best stretches of all but ``rate`` of the held-back
    ordinary samples stay below and all but ``10 * rate`` of the held-back random ones stay above.
    """
    a, b = _chain(random_strings), _chain(ordinary)
    open_model = Model(a[0] - b[0], a[1] - b[1], 0.0)
    low = np.quantile([open_model.best(t) for t in held_ordinary], 1 - rate)
    high = np.quantile([open_model.best(t) for t in held_random], 10 * rate)
    return Model(open_model.first, open_model.step, float(max(low, (low + high) / 2)))


def default_model(n: int = 20_000, seed: int = 7) -> Model:
    return train(samples(1, n, seed), samples(0, n, seed), samples(1, n // 2, seed + 1), samples(0, n // 2, seed + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans; matches run leftmost, then those too short go."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A maximal run of hex digits is 24 long or longer exactly where this pattern matches.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def pieces(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs, without what the sorted pattern spans cover."""
    at, i = 0, 0
    for m in RUN.finditer(text):
        if m.end() - m.start() < 2:
            continue
        at = m.start()
        while i < len(base) and base[i][2] <= at:
            i += 1
        j = i
        while j < len(base) and base[j][0] < m.end():
            if base[j][0] > at:
                yield at, base[j][0]
            at = max(at, base[j][2])
            j += 1
        if at < m.end():
            yield at, m.end()


def scan(text: str, model: Model, shortest: int = SHORTEST) -> list[dict]:
    base = base_spans(text)
    found = [{"kind": KINDS[k], "start": s, "end": e, "ratio": None} for s, k, e in base]
    for a, b in pieces(text, base):
        if b - a >= shortest:
            found += [{"kind": KINDS[3], "start": a + s, "end": a + e, "ratio": r} for s, e, r in model.stretches(text[a:b], shortest)]
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"])))


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("ratio", DoubleType())])
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``df``: doc_id and its spans, by start, then by kind as listed in KINDS."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.array([scan(t or "", shared.value, shortest) for t in column.to_pylist()], _ARROW_SPAN)]

    return map_text(narrow(df, id_col, text_col), ["doc_id"], "text", compute, [StructField("found", ArrayType(SPAN))])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
