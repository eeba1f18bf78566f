"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

Base spans come from four patterns with checks. The field runs over the candidate tokens of a whole document, those
with a digit or an ``@``; every other token is an observed "no entity". Potentials are of three kinds:

* a token's own shape, digits, punctuation and neighbouring words;
* chain edges between candidates that stand next to each other;
* skip edges between consecutive occurrences of a repeated or similar token, however far apart: the same token (of four characters or more), the same last seven
  digits (of the token, or of the run of numbers that it ends), or an e-mail address and its local part.

Tokens under base spans are known, and the others' marginals come from loopy belief propagation over the graph with its
cycles; skip edges carry what is known of one mention to others in a form that no pattern has. Weights are learned by
pseudo-likelihood on a bounded sample. Its labels are the base spans, values that a key name calls a secret, and planted
mentions: a base span's value in another form, which is personal data where the document has the span too, and nothing
where the span has been cut out. Features are left out at random, so that no single one decides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import small_batches

KINDS = ["email", "ip", "card", "phone"]
#: What the field tells apart; secrets (keys, tokens, passwords) have no base pattern.
LABELS = ["none", *KINDS, "secret"]
#: Bound of the training sample: about so many documents.
TRAIN_DOCS = 3_000
#: A span is added at this marginal probability: on planted mentions the largest that still finds about nine of ten.
SURE = 0.9
_BITS = 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored at the start of a run of digits: the same matches, without retries inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SEED = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]")
_OUTER = ".,;:!?()[]{}<>\"'*#&%$"
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?([^\s\"'<>]{12,})")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an ``@``."""
    out, at = [], 0
    n = len(text)
    while m := _SEED.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, m.end())
        end = blank.start() if blank else n
        out.append((start, end))
        at = end
    return out


def _shape(token: str) -> str:
    """Characters as classes, with runs shortened to at most three."""
    out = re.sub(r"[a-zß-\U0010ffff]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[0-9]", "9", token)))
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", out)


def _opaque(core: str) -> str:
    """``hex`` or ``mixed`` for a long run of letters and digits without sense, else empty."""
    if not _OPAQUE.fullmatch(core) or core.isdigit() or not any(map(str.isalpha, core)):
        return ""
    return "hex" if not core.lower().strip("0123456789abcdef") else "mixed"


def _checked(token: str) -> str:
    """Whether a number as long as a card's has a card's check digit."""
    digits = "".join(_DIGITS.findall(token)) if sum(map(str.isalpha, token)) <= 1 else ""
    return ("fails", "holds")[luhn(digits)] if 16 <= len(digits) <= 19 else ""


def _features(text: str, spans: list[tuple[int, int]], i: int) -> list[int]:
    """Hashed features of the whole token, the two words left of it and the one right of it, within 32 characters."""
    start, end = spans[i]
    token = text[start:end]
    left = ["^", "^", *text[max(0, start - 32) : start].split()][-2:]
    right = (text[end : end + 32].split() or ["$"])[0]
    core = token.strip(_OUTER)
    names = ["bias", "s:" + _shape(token), "c:" + _shape(core), f"d:{min(len(_DIGITS.findall(token)), 20)}", f"@:{'@' in token}", f".:{min(token.count('.'), 5)}", f"-:{min(token.count('-'), 4)}", "f:" + token[:1], "e:" + token[-1:],
             "l:" + left[1].lower(), "k:" + left[0].lower(), "r:" + right.lower(), f"n:{min(len(token), 40) // 2}", "rs:" + _shape(right), "ls:" + _shape(left[1]), "x:" + _opaque(core), "v:" + _checked(token)]
    return [zlib.crc32(x.encode()) & (1 << _BITS) - 1 for x in names]


N_FEATURES = 17


def _keys(text: str, spans: list[tuple[int, int]]) -> Iterator[list[str]]:
    """What each candidate shares with its similar ones."""
    run = ""
    for i, (start, end) in enumerate(spans):
        token = text[start:end]
        core = token.strip(_OUTER).lower()
        digits = "".join(_DIGITS.findall(token))
        plain = "@" not in token and not any(map(str.isalpha, token))
        run = (run if plain and i and start - spans[i - 1][1] <= 2 else "") + digits if plain else ""
        keys = [core] if len(core) >= 4 else []
        if "@" in core:
            local = core.split("@", 1)[0]
            if len(local) >= 4:
                keys.append(local)
        elif len(digits) >= 7 and not _opaque(core):
            keys.append(digits[-7:])
        elif len(run) >= 7:
            keys.append(run[-7:])
        yield keys
        run = run[-19:]


def graph(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Feature ids (a row a candidate), chain edges, skip edges."""
    feats = np.array([_features(text, spans, i) for i in range(len(spans))], dtype=np.int32).reshape(len(spans), N_FEATURES)
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2]
    last: dict[str, int] = {}
    skip = []
    for i, keys in enumerate(_keys(text, spans)):
        for j in sorted({last[k] for k in keys if k in last}):
            if j + 1 < i or spans[i][0] - spans[j][1] > 2:
                skip.append((j, i))
        last.update(dict.fromkeys(keys, i))
    return feats, chain, skip


@dataclass
class SkipChainCRF:
    """``unary`` (features x labels), and symmetric potentials of chain and skip edges (labels x labels)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, feats: np.ndarray, chain: np.ndarray, skip: np.ndarray, known: np.ndarray | None = None, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product on all documents of a batch at once; edges are pairs of places, ``known`` a label or -1 for each place."""
        n, k = len(feats), self.unary.shape[1]
        local = np.zeros((n, k))
        for column in feats.T:
            local += self.unary[column]
        if known is not None:
            fixed = np.flatnonzero(known >= 0)
            local[fixed] = -1e3
            local[fixed, known[fixed]] = 0.0
        chain, skip = chain.reshape(-1, 2), skip.reshape(-1, 2)
        # Messages forth along all edges, then back along them.
        src, dst = (np.concatenate([chain[:, i], skip[:, i], chain[:, 1 - i], skip[:, 1 - i]]) for i in (0, 1))
        ends = np.cumsum([0, len(chain), len(skip), len(chain), len(skip)])
        tables = [np.exp(t) for t in (self.chain, self.skip, self.chain.T, self.skip.T)]
        back = np.roll(np.arange(len(src)), len(chain) + len(skip))
        message = np.zeros((len(src), k))  # logarithms

        def belief() -> np.ndarray:
            return local + np.stack([np.bincount(dst, weights=message[:, j], minlength=n) for j in range(k)], axis=1)

        for _ in range(rounds if len(src) else 0):
            sent = belief()[src] - message[back]
            sent = np.exp(sent - sent.max(axis=1, keepdims=True))
            new = np.concatenate([sent[a:b] @ t for a, b, t in zip(ends, ends[1:], tables, strict=False)])
            new = np.log(np.maximum(new, 1e-300))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = damping * message + (1 - damping) * new
            if moved < 1e-6:
                break
        b = belief()
        e = np.exp(b - b.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, feats: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, weight: np.ndarray | None = None, steps: int = 1500, rate: float = 0.1, l2: float = 2e-5, dropped: float = 0.2, batch: int = 2048) -> SkipChainCRF:
        """Pseudo-likelihood: each label given its neighbours' labels; Adam on batches of places drawn by ``weight``, each without a share ``dropped`` of the features.

        A label of -1 is unknown, and counts neither for itself nor for its neighbours.
        """
        k, n = len(LABELS), len(labels)
        own = np.eye(k)[labels] * (labels >= 0)[:, None]

        def around(edges: np.ndarray) -> np.ndarray:
            out = np.zeros((n, k))
            if len(edges):
                np.add.at(out, edges[:, 0], own[edges[:, 1]])
                np.add.at(out, edges[:, 1], own[edges[:, 0]])
            return out

        by_chain, by_skip = around(chain), around(skip)
        upto = np.cumsum((np.ones(n) if weight is None else weight) * (labels >= 0))
        rng = np.random.default_rng(5)
        params = [np.zeros((1 << _BITS, k)), np.zeros((k, k)), np.zeros((k, k))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, (steps if upto[-1] else 0) + 1):
            at = np.minimum(np.searchsorted(upto, rng.random(batch) * upto[-1], side="right"), n - 1)
            own_feats, chained, skipped = feats[at], by_chain[at], by_skip[at]
            kept = (rng.random(own_feats.shape) >= dropped) / (1 - dropped)
            z = np.einsum("nfk,nf->nk", params[0][own_feats], kept) + chained @ params[1] + skipped @ params[2]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - own[at]) / batch
            g0 = np.stack([np.bincount(own_feats.reshape(-1), weights=(kept * d[:, j, None]).reshape(-1), minlength=1 << _BITS) for j in range(k)], axis=1)
            pair = [chained.T @ d, skipped.T @ d]
            for i, g in enumerate([g0, *((x + x.T) / 2 for x in pair)]):
                g = g + l2 * params[i]
                m, v = moments[i]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                params[i] -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(*params)


def _token_labels(spans: list[tuple[int, int]], named: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each candidate: the kind of a span that touches it (of several the one that starts last), or 0."""
    out, at = np.zeros(len(spans), dtype=np.int64), 0
    for kind, start, end in sorted(named, key=lambda s: (s[1], s[2])):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        i = at
        while i < len(spans) and spans[i][0] < end:
            out[i] = LABELS.index(kind)
            i += 1
    return out


def _doubtful(labels: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], named: np.ndarray) -> np.ndarray:
    """``labels`` with -1 for places that no pattern names though they are linked to one that has a name: they teach nothing.

    Also their neighbours without a name. ``named`` marks places whose label is sure.
    """
    out = labels.copy()
    for i, j in skip:
        for a, b in ((i, j), (j, i)):
            if labels[a] > 0 and not labels[b] and not named[b]:
                out[b] = -1
    for i, j in [*chain, *reversed(chain)]:
        for a, b in ((i, j), (j, i)):
            if out[a] < 0 and not labels[b] and not named[b]:
                out[b] = -1
    return out


def _secrets(text: str) -> list[tuple[str, int, int]]:
    return [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]


def other_form(kind: str, value: str, choice: int) -> str | None:
    """The value of a base span as no base pattern has it; None if this kind has no such form."""
    digits = "".join(_DIGITS.findall(value))
    if kind == "phone":
        d = digits[-10:]
        return [d, d[-7:-4] + "-" + d[-4:], ".".join(x for x in (d[:-7], d[-7:-4], d[-4:]) if x), f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}" if len(d) > 7 else d][choice % 4]
    if kind == "card":
        return ["/", "_", "."][choice % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "email":
        local, domain = value.split("@", 1)
        form = [local, f"{local}@{domain.split('.')[0]}", f"{local}@"][choice % 3]
        return form if len(local) >= 4 and _SEED.search(form) else None
    return None


def _planted(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """``text`` as it is with its labels, and up to three copies with something planted at other places.

    A base span's value in another form; the same form, once or twice, where the span has been cut out; a number without meaning, repeated.
    """
    base, secrets = base_spans(text), _secrets(text)
    yield text, base + secrets
    lot = zlib.crc32(text.encode())

    def planted(whole: str, forms: list[str], kind: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        held, named = whole, []
        for i, form in enumerate(forms):
            at = held.find(" ", (lot >> 3 * i) % (len(held) + 1))
            if at < 0 or any(a - 1 <= at <= b for _, a, b in [*base_spans(held), *named]):
                at = len(held)
            held = f"{held[:at]} {form} .{held[at:]}"
            shift = len(form) + 3
            named = [(k, a + shift * (a >= at), b + shift * (a >= at)) for k, a, b in named] + ([(kind, at + 1, at + 1 + len(form))])
        own = base_spans(held)
        if not any(a < e and s < b for _, a, b in own for _, s, e in named):  # else the patterns see it after all
            yield held, own + _secrets(held) + named

    able = [s for s in base if s[0] != "ip"]
    if able:
        kind, start, end = able[lot % len(able)]
        form = other_form(kind, text[start:end], lot >> 8)
        if form:
            yield from planted(text, [form], kind)
            without = text[:start] + text[end:]
            if text[start:end] not in without:
                yield from planted(without, [form] * (1 + (lot >> 16 & 1)), "none")
    if base or secrets:
        digits = str(lot) + str(zlib.crc32(str(lot).encode()))
        number = digits[: (4, 7, 10, 16)[lot >> 5 & 3]]
        yield from planted(text, [number] * 2, "none")


def train_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> SkipChainCRF | None:
    """Fit the field on about ``train_docs`` documents with candidate tokens, chosen by a hash; None if there are no candidates.

    Two scans: one counts such documents, one draws the sample. The driver gets hashed features and labels, no texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    count = rows.count()
    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    schema = pa.schema([("feats", pa.binary()), ("labels", pa.binary()), ("chain", pa.binary()), ("skip", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole in batch.column(0).to_pylist():
                for text, named in _planted(whole):
                    spans = candidates(text)
                    feats, chain, skip = graph(text, spans)
                    labels = _token_labels(spans, named)
                    told = _token_labels(spans, [("email", a, b) for _, a, b in named]) > 0
                    labels = _doubtful(labels, chain, skip, told)
                    out.append((feats.tobytes(), (labels + len(LABELS) * told).tobytes(), np.array(chain, dtype=np.int64).tobytes(), np.array(skip, dtype=np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 4, schema=schema)

    sampled = rows.where(unit < min(1.0, train_docs / max(1, count))).select("text").mapInArrow(emit, "feats binary, labels binary, chain binary, skip binary")
    feats, labels, weight, chain, skip, n = [], [], [], [], [], 0
    for r in sorted((tuple(map(bytes, r)) for r in sampled.collect())):
        own = np.frombuffer(r[1], dtype=np.int64)
        feats.append(np.frombuffer(r[0], dtype=np.int32).reshape(-1, N_FEATURES))
        labels.append(np.where(own < 0, own, own % len(LABELS)))
        weight.append(np.where(own >= len(LABELS), 4.0, 1.0))  # what patterns or plants name is rare
        chain.append(np.frombuffer(r[2], dtype=np.int64).reshape(-1, 2) + n)
        skip.append(np.frombuffer(r[3], dtype=np.int64).reshape(-1, 2) + n)
        n += len(own)
    if not n:
        return None
    return SkipChainCRF.fit(np.concatenate(feats), np.concatenate(labels), np.concatenate(chain), np.concatenate(skip), np.concatenate(weight))


def added_spans(text: str, spans: list[tuple[int, int]], p: np.ndarray, base: list[tuple[str, int, int]], sure: float) -> list[tuple[str, int, int]]:
    """Candidates that the field is ``sure`` of and no base span touches, without outer punctuation; neighbours of one kind join."""
    out: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    at, before = 0, -2
    for i, (start, end) in enumerate(spans):
        j = int(p[i].argmax())
        if not j or p[i, j] < sure:
            continue
        raw = start
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start == end or at < len(taken) and taken[at][0] < end:
            continue
        kind = LABELS[j]
        if kind == "secret" and (m := _SECRET.search(text, start, end)):  # the value without its name
            start, end = m.span(1)
        if before == i - 1 and out[-1][0] == kind and raw - spans[before][1] <= 2:
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, start, end))
        before = i
    return out


def detect(texts: list[str], model: SkipChainCRF | None, sure: float) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text; one propagation for all texts of the call."""
    base = [base_spans(t) for t in texts]
    spans = [candidates(t) for t in texts]
    held = [i for i, s in enumerate(spans) if s]
    found: dict[int, list[tuple[str, int, int]]] = {}
    if model is not None and held:
        feats, chain, skip, known, first, n = [], [], [], [], {}, 0
        for i in held:
            f, c, s = graph(texts[i], spans[i])
            feats.append(f)
            own = _token_labels(spans[i], base[i])
            known.append(np.where(own > 0, own, -1))
            chain += [(a + n, b + n) for a, b in c]
            skip += [(a + n, b + n) for a, b in s]
            first[i] = n
            n += len(f)
        p = model.marginals(np.concatenate(feats), np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2), np.concatenate(known))
        found = {i: added_spans(texts[i], spans[i], p[first[i] : first[i] + len(spans[i])], base[i], sure) for i in held}
    return [(b, sorted(b + found.get(i, []), key=lambda s: (LABELS.index(s[0]), s[1]))) for i, b in enumerate(base)]


def _chunks(texts: list[str], limit: int = 1 << 19) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def find_pii(docs: DataFrame, model: SkipChainCRF | None, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """Spans of every whole text: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, n_secret``.

    Counts and digest are those of the base spans; ``spans`` is ``kind:start:end``, comma-joined, of all of the four kinds, and
    ``n_added`` says how many of them the field found. ``secrets`` has the secrets, all of them the field's. Null text: empty, no
    spans. Repeated rows and null ids: a row each. Empty table: no rows. Without a model only base spans are
    found. One pass, no shuffle; a batch's memory follows its longest text.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_secret"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64()]

    def told(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [x for part in _chunks(texts) for x in detect(part, model, sure)]
            personal = [[s for s in every if s[0] != "secret"] for _, every in found]
            secrets = [[s for s in every if s[0] == "secret"] for _, every in found]
            columns = [batch.column(0), *([sum(k == s[0] for s in base) for base, _ in found] for k in KINDS),
                       [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], list(map(told, personal)), [len(p) - len(base) for p, (base, _) in zip(personal, found, strict=True)], list(map(told, secrets)), list(map(len, secrets))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, secrets string, n_secret long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def redact_pii(docs: DataFrame, model: SkipChainCRF | None, text_col: str = "text", sure: float = SURE) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; all columns stay, in order.

    Overlapping spans are replaced together, under the kind of the first. Null text stays null.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, last = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
            if start >= last:
                out += [text[last:start], f"<{kind.upper()}>"]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).to_pylist()
            texts = [t or "" for t in raw]
            found = [x for part in _chunks(texts) for x in detect(part, model, sure)]
            new = [None if r is None else redacted(t, every) for r, t, (_, every) in zip(raw, texts, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
