"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap: the four base
kinds with their validators, and looser shapes (addresses written out, local
and grouped phone numbers, national numbers, bank accounts, IPv6, digit runs,
assigned secrets).  Boosted trees judge the looser ones by format and context,
and thresholds that were calibrated for precision select.  Base spans always
stay.

The trees are trained here, on seeded synthetic snippets of things that are and
that only look like personal data, many of them in the form of the other; no
table is read for it.  Snippets are carried by phrases, of which one part trains
and another one calibrates, so that a threshold holds for phrases not learned.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.boosting import Boosted
from somaflow.llm.textbytes import CHUNK

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the looser generators, in the order in which ``spans`` lists them after the base kinds.
MORE = ("email_text", "phone_local", "national", "iban", "ipv6", "number", "secret")
PRECISION = 0.95
#: Code points on both sides that are a candidate's context, and how near another span counts.
CONTEXT = 32
NEAR = 100
#: Candidates that are judged at once.
AT_ONCE = 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "phone_local": re.compile(r"(?<![\w+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "national": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "number": re.compile(r"(?<![\w.-])[0-9]{9,19}(?![\w-])"),
    "secret": re.compile(r"(?<![\w/+=.-])(?=[\w/+=.-]*[0-9])(?=[0-9_/+=.-]*[A-Za-z])[\w/+=.-]{16,}(?![\w/+=-])", re.ASCII),
}
#: The sign, domain and ending of an address in words; what stands before the sign is looked for from there.
_AT_DOT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
#: Words near a span that speak for or against each kind; context is compared by whole words.
_FOR = frozenset(
    "mail email inbox contact write reach phone call tel fax mobile cell dial ring text sms ssn social security tax id iban bank account wire transfer pay card visa payment charge paid "
    "ip host address server client login ssh ping passport pass name customer token secret key apikey api password passwd pwd auth bearer authorization credential credentials private access".split()
)
_AGAINST = frozenset(
    "version isbn issn doi order invoice page article date price total table figure section chapter part model serial sku build release score size meeting look line lot catalogue clause row population "
    "timestamp file module years coordinates shipped stock ref commit hash sha sha1 sha256 md5 checksum digest etag uuid image revision branch".split()
)
_WORD = re.compile(r"[a-z][a-z0-9]*")
#: How well-known keys begin.
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
#: Phrases that carry snippets, for and against; every other one calibrates.
_CARRIERS = {
    "email_text": (
        ["drop me a note, {}, any time", "get in touch: {}", "she answers mail under {} on weekdays", "my inbox is {} as ever", "questions go to {} only", "contact {} for a copy", "signed, the editor, {}", "write us: {}"],
        ["we met at the bridge, {} as they say", "a look at it: {} was the line on the poster", "the meeting was at noon; {} stood on the page", "chapter two, {}, is the best"],
    ),
    "phone_local": (
        ["ring {} after six", "text us on {} please", "my number is {}", "dial {} and ask for her", "phone: {}", "fax {} works too", "call the desk, {}, for help", "mobile {} (evenings)"],
        ["lot {} of the catalogue", "coordinates {} on the old map", "the years {} were good", "scores of {} in the table", "part {} is out of stock", "release {} of the file", "invoice {} from May", "rows {} of the sheet"],
    ),
    "national": (
        ["the tax office knows her as {}", "id {} on the form", "social security {}", "ssn: {}", "her number there is {}", "registered under {} since birth", "born here, {}, and insured", "applicant {} signed"],
        ["part {} is out of stock", "order {} shipped today", "clause {} of the act", "catalogue no. {}", "serial {} on the back", "see page {} there", "sku {} in blue", "invoice {} is due"],
    ),
    "iban": (
        ["wire it to {}", "transfer the rent to {} please", "pay into {}", "our bank: {}", "account {} is hers", "iban {}", "send the money to {}", "the fee goes to {} by May"],
        ["model {} has shipped", "serial {} on the lid", "part {} is out of stock", "file {} in the folder", "build {} passed", "licence plate {} was seen"],
    ),
    "ipv6": (
        ["ssh to {} and log in", "the client came from {}", "ping {} first", "host {} is down", "our server has {}", "requests of {} were refused"],
        ["the interval {} was logged", "at {} the run began", "the hash {} of the file", "etag {} stayed"],
    ),
    "number": (
        ["charge it to {}", "paid with {} at the desk", "passport {} of the guest", "her pass reads {}", "card {} was declined", "visa {} please", "account {} is empty", "her tax id is {}"],
        ["a population of {}", "row {} of the file", "timestamp {} in the log", "order {} shipped", "isbn {} (paper)", "invoice {}", "revision {} of it", "{} was the total", "the sum {} again", "item {} there"],
    ),
    "secret": (
        ['token = "{}"', 'TOKEN="{}"', "api_key: {}", "export SECRET={}", 'password = "{}"', "Authorization: Bearer {}", 'auth_token: "{}"', "private key {}", "access key is {} for now", 'credentials: "{}"', "pwd={}", "secret {}"],
        ["commit {} fixes it", "sha256:{}", "see the file {} there", "the image {} was built", "checksum {}", "module {} of the build", "the page {} moved", "hash {}", "etag: {}", "branch {} is merged", "uuid {}", "md5 {} of it"],
    ),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start.

    The email pattern is matched around each ``@``: its first part is the run
    of its characters before the sign, from the end of the match before.
    """
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _mod97(text: str) -> bool:
    t = text.replace(" ", "")
    t = t[4:] + t[:4]
    return int("".join(str(int(c, 36)) for c in t)) % 97 == 1


def features(text: str, kind: str, start: int, end: int, near: int = NEAR) -> list[float]:
    """Format and context of a candidate; ``near``: code points to the next base span, at most NEAR."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    ahead, behind = (set(_WORD.findall(x.lower())) for x in (before, after))
    groups = re.findall(r"[0-9]+", span)
    letters = [c for c in span if c.isalpha()]
    return [
        MORE.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/") + span.count("_"), len(set(span)) / len(span), luhn(digits) if digits else 0,
        kind == "iban" and _mod97(span), digits[:1] == "0", digits[:2] in ("19", "20"), all(c in "0123456789abcdefABCDEF" for c in span),
        any(c.islower() for c in letters) and any(c.isupper() for c in letters), span.startswith(_KEYS),
        len(ahead & _FOR), len(ahead & _AGAINST), len(behind & _FOR), len(behind & _AGAINST), any(w in _AGAINST for w in _WORD.findall(span.lower())),
        ":" in before[-3:], "=" in before[-4:], before[-1:] in ('"', "'"), "#" in before[-2:], any(c in before[-3:] + after[:3] for c in "$€£%"), near < NEAR,
        kind == "national" and (digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000"),
    ]


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses in words: two characters and more before the sign, the first a letter or digit that no word, stop or hyphen is joined to."""
    done = 0
    for m in _AT_DOT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _NAME:
            start -= 1
        if not (start and (text[start - 1] == "_" or text[start - 1].isalnum())):
            while start < m.start() and text[start] in "._-":
                start += 1
            if m.start() - start > 1:
                yield "email_text", start, m.end()
        done = m.end()


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of the looser generators; they may overlap each other and base spans.  No span has a longest length."""
    out = list(_addresses(text)) if "at" in text and "dot" in text else []
    if any(d in text for d in "0123456789"):
        for kind, pattern in _LOOSE.items():
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def _snippets(rng: np.random.Generator, n: int):
    """(text, kind, label, held): synthetic snippets around one candidate each; held ones calibrate."""
    words = "the report of last week was read by all people here and there again with some care before noon while rain fell on old roofs near a quiet harbour".split()
    draw = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda x: x[int(rng.integers(len(x)))]
    name = lambda: "".join(pick("aeioulmnrst") for _ in range(int(rng.integers(3, 9))))
    some = lambda letters, k: "".join(pick(letters) for _ in range(k))
    size = lambda a, b: int(rng.integers(a, b))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card():
        d = draw(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban():
        body = draw(18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if _mod97(f"DE{c:02d}{body}"))

    def key():
        return pick([some("0123456789abcdef", pick([32, 40, 64])), some(mixed, size(20, 60)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + some(mixed, 36), "sk-" + some(mixed, 40), some(mixed + "+/", 43) + "=", "eyJ" + ".".join(some(mixed + "-_", size(*pick([(15, 40), (40, 120), (120, 900)]))) for _ in range(3))])

    yes = {
        "email_text": lambda: f"{name()} {pick(['at', '(at)', '[at]'])} {name()} {pick(['dot', '(dot)', '[dot]'])} {pick(['com', 'org', 'net'])}",
        "phone_local": lambda: pick([f"({draw(3)}) {draw(3)}-{draw(4)}", f"{draw(3)}-{draw(3)}-{draw(4)}", f"{draw(3)}.{draw(3)}.{draw(4)}", f"{draw(3)} {draw(3)} {draw(4)}"]),
        "national": lambda: f"{rng.integers(100, 660)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        "iban": iban,
        "ipv6": lambda: ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8)),
        "number": lambda: card() if rng.random() < 0.7 else draw(9),
        "secret": key,
    }
    no = {
        "email_text": lambda: f"{name()} at {name()} dot {name()}",
        "phone_local": lambda: pick([f"{rng.integers(1900, 2030)} {draw(3)} {draw(3)}", f"{draw(2)}.{draw(3)}.{draw(3)}", f"{draw(3)} {draw(3)} {draw(3)}"]),
        "national": lambda: f"{pick(['000', '666', '9' + draw(2)])}-{draw(2)}-{draw(4)}",
        "iban": lambda: f"{pick(['AB', 'XY', 'QQ'])}{draw(2)} {draw(4)} {draw(4)} {draw(4)}",
        "ipv6": lambda: ":".join(draw(2) for _ in range(5)),
        "number": lambda: draw(size(9, 20)),
        "secret": lambda: pick([f"{name()}_{name()}_{name()}{draw(2)}.{pick(['png', 'py', 'html'])}", f"{name()}-{name()}-{draw(4)}-{draw(2)}-{draw(2)}", "/".join(name() for _ in range(4)) + draw(2), f"{name()}.{name()}.example{draw(1)}.com", f"//{name()}.example.com/{name()}/{draw(4)}-{draw(2)}/{name()}", f"//www.{name()}.com/{name()}-{name()}-{draw(5)}.html"]),
    }
    for i in range(n):
        kind, label, held = MORE[i % len(MORE)], size(0, 2), i // len(MORE) % 3 == 2
        # half of those that aren't have the form, and some that are, or aren't, have no phrase
        span = (yes if label or rng.random() < 0.5 else no)[kind]()
        said = pick(_CARRIERS[kind][1 - label][held::2])
        bare = rng.random() < (0.15 if label else 0.4) and not (label and kind == "secret")
        if bare and not label:
            span = no[kind]()
        around = [" ".join(pick(words) for _ in range(size(2, 8))) for _ in range(2)]
        text = f"{around[0]} {'{}' if bare else said}{pick(['. ', ' ', ', '])}{around[1]}"
        at = text.index("{}")
        yield text[:at] + span + text[at + 2 :], kind, label, held, at, NEAR // 2 if rng.random() < (0.4 if label else 0.2) else NEAR


@functools.cache
def model(seed: int = 11, rows: int = 10_000, precision: float = PRECISION) -> dict[str, Boosted]:
    """One forest for all kinds, with a threshold for each kind that reaches ``precision`` on held-out phrases.

    ``quality`` of each has the precision and recall there.
    """
    x, y, kinds, held = [], [], [], []
    for text, kind, label, hold, at, near in _snippets(np.random.default_rng(seed), rows):
        for k, a, b in candidates(text):
            if k == kind and a <= at + 1 < b:
                x.append(features(text, k, a, b, near))
                y.append(label)
                kinds.append(k)
                held.append(hold)
                break
    x, y, kinds, held = np.array(x, float), np.array(y, float), np.array(kinds), np.array(held)
    forest = Boosted(rounds=80, depth=4).fit(x[~held], y[~held])
    out = {}
    for k in MORE:
        own = Boosted()
        own.__dict__ |= forest.__dict__
        mine = held & (kinds == k)
        out[k] = own.calibrate(x[mine], y[mine], precision) if mine.any() else own
        own.threshold = max(own.threshold, 0.5)
        taken = own.predict(x[mine]) >= own.threshold
        own.quality = float(y[mine][taken].mean()) if taken.any() else 1.0, float(taken[y[mine] > 0].mean())
    return out


def fitted(spark: SparkSession) -> dict[str, Boosted]:
    """The forest, grown by one task away from the driver; what comes back are its trees."""

    def task(_) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"trees": pa.array([pickle.dumps(model())], pa.binary())})

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(task, "trees binary").first()["trees"])


def _nearest(spans: list[tuple[str, int, int]], start: int, end: int) -> int:
    """Code points from a candidate to the next base span, at most NEAR; ``spans`` by start."""
    i = bisect.bisect_left(spans, start, key=lambda z: z[1])
    gaps = [max(0, start - spans[i - 1][2])] if i else []
    if i < len(spans):
        gaps.append(max(0, spans[i][1] - end))
    return min([*gaps, NEAR])


def _outer(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that don't lie within another one; of equal ones the first kind's."""
    out: list[tuple[str, int, int]] = []
    for z in sorted(spans, key=lambda z: (z[1], -z[2], MORE.index(z[0]))):
        if not out or z[2] > out[-1][2]:
            out.append(z)
    return out


def found(texts: list[str], trees: dict[str, Boosted]) -> dict[str, list]:
    """Result columns of some texts."""
    base = [base_spans(t) for t in texts]
    more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    loose: list[tuple] = []
    for i, t in enumerate(texts):
        if not (some := candidates(t)):
            continue
        order = sorted(base[i], key=lambda z: z[1])
        reach = list(itertools.accumulate((z[2] for z in order), max))  # furthest end of the spans that start so far
        for k, a, b in some:
            n = bisect.bisect_right(order, a, key=lambda z: z[1])
            if not (n and reach[n - 1] >= b):
                loose.append((i, k, a, b, _nearest(order, a, b)))
    for at in range(0, len(loose), AT_ONCE):
        part = loose[at : at + AT_ONCE]
        p = next(iter(trees.values())).predict(np.array([features(texts[i], k, a, b, near) for i, k, a, b, near in part], float))
        for (i, k, a, b, _), q in zip(part, p.tolist()):
            if q >= trees[k].threshold:
                more[i].append((k, a, b))
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    out = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in KINDS}
    out["base_sha256"] = [hashlib.sha256(line(s).encode()).hexdigest() for s in base]
    more = [_outer(m) for m in more]
    out["spans"] = [line([*s, *sorted(m, key=lambda z: (MORE.index(z[0]), z[1]))]) for s, m in zip(base, more)]
    out["n_spans"] = [len(s) + len(m) for s, m in zip(base, more)]
    return out


COLUMNS = {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string", "n_spans": "long"}


def detected(docs: DataFrame) -> DataFrame:
    """doc_id and the result columns, one row per document; counts by kind and the digest are of the base kinds, n_spans of all.

    Spans are kind:start:end in code points, end exclusive.  Defined results: a
    null text is an empty one, without spans; a looser span inside a base span,
    or inside another looser one, is not listed; an empty table gives no rows.
    """
    trees = fitted(docs.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string()}

    def task(batches):
        for batch in batches:
            texts, start, size = [t or "" for t in batch.column(1).to_pylist()], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK or k + 1 == len(texts):
                    cols = found(texts[start : k + 1], trees)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k + 1 - start), *(pa.array(cols[c], kinds[d]) for c, d in COLUMNS.items())], ["doc_id", *COLUMNS])
                    start, size = k + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
