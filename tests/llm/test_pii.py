import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm.pii import LABELS, N_FEATURES, SURE, SkipChainCRF, base_spans, candidates, detect, find_pii, graph, luhn, other_form, redact_pii, train_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+1 2(5é", max_size=50))
def test_patterns_equal_the_plain_ones(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a.b" * 100_000 + "@", "1." * 150_000, "+" * 100_000, "1 " * 100_000, "@" * 100_000):
        base_spans(text)
        candidates(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def corpus():
    random.seed(2)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(250):
        words = [random.choice(["lorem", "ipsum", "dolor", f"n{digits(2)}", digits(3)]) for _ in range(40)]
        words[5] = random.choice([f"u{digits(3)}@mail{digits(1)}.example.com", f"10.{random.randrange(255)}.3.{random.randrange(255)}", f"+1 ({digits(3)}) 555-{digits(4)}"])
        rows.append((i, " ".join(words)))
    return rows


def test_exact_marginals_on_a_tree_and_consistency_over_skip_edges():
    rng = np.random.default_rng(0)
    k = len(LABELS)
    model = SkipChainCRF(rng.normal(size=(1 << 13, k)), rng.normal(size=(k, k)), np.eye(k) * 2)
    feats = rng.integers(0, 1 << 13, size=(3, N_FEATURES)).astype(np.int32)
    chain, skip = np.array([[0, 1]]), np.array([[0, 2]])
    local = model.unary[feats].sum(axis=1)
    joint = np.array([[[np.exp(local[0, a] + local[1, b] + local[2, c] + model.chain[a, b] + model.skip[a, c]) for c in range(k)] for b in range(k)] for a in range(k)])
    joint /= joint.sum()
    p = model.marginals(feats, chain, skip, rounds=60)
    assert np.allclose(p, [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))], atol=1e-4)
    # A distant mention takes over what a sure one of the same token is.
    unary = np.zeros((1 << 13, k))
    unary[7, 4] = 1.0
    weak = SkipChainCRF(unary, np.zeros((k, k)), np.eye(k) * 3)
    two = np.stack([np.full(N_FEATURES, 7), np.zeros(N_FEATURES)]).astype(np.int32)
    assert weak.marginals(two, np.zeros((0, 2), int), np.array([[0, 1]]))[1].argmax() == 4
    text = "call +1 (499) 555-6503 or later 555-6503, thanks 12"
    assert graph(text, candidates(text))[2] == [(2, 3)]


def test_skip_edge_between_distant_mentions_without_candidates_between():
    text = "call 555-6503 at any time of the day or the night, or else later on 555-6503"
    assert graph(text, candidates(text))[1:] == ([], [(0, 1)])
    for text, chain, skip in (("555-6503 555-6503", [(0, 1)], []), ("555-6503   555-6503", [], [(0, 1)]), ("555-6503 12 555-6503", [(0, 1), (1, 2)], [(0, 2)])):
        assert graph(text, candidates(text))[1:] == (chain, skip)
    # What is known of one mention reaches the other.
    unary = np.zeros((1 << 13, len(LABELS)))
    text = "+1 (499) 555-6503 is what they gave us, and much later 555-6503"
    spans = candidates(text)
    feats, chain, skip = graph(text, spans)
    assert skip == [(2, 3)]
    unary[list(set(feats[2].tolist()) - set(feats[3].tolist())), LABELS.index("phone")] = 1.0
    model = SkipChainCRF(unary, np.zeros((len(LABELS),) * 2), np.eye(len(LABELS)) * 3)
    p = model.marginals(feats, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2))
    assert LABELS[p[3].argmax()] == "phone" and p[3].max() > 0.5  # 0.2 without an edge


def test_similar_mentions_share_an_edge():
    for a, b in (("mail jo.7@x.example.com now", "or jo.7"), ("card 4111 1111 1111 1111 and", "4111/1111/1111/1111"), ("+1 (499) 555-6503 or", "4995556503"), ("see K9-77", "and k9-77,")):
        text = f"{a} some words between {b} end"
        spans = candidates(text)
        assert graph(text, spans)[2][-1][1] == len(spans) - 1, text
    assert graph("a 12 and b 34", candidates("a 12 and b 34"))[2] == []


def test_long_texts_of_candidates():
    for text in ("1 " * 60_000, "a@b.c " * 20_000, "1" * 200_000 + "@"):
        model = SkipChainCRF(np.zeros((1 << 13, 6)), np.zeros((6, 6)), np.zeros((6, 6)))
        assert detect([text], model, SURE)[0][1] == base_spans(text)


def planted(i, kind, spans=True, forms=True):
    """A text with a span, its value in another form, or both (and where that form stands)."""
    rng = random.Random(i)
    digits = "".join(rng.choice("123456789") for _ in range(10))
    card = next(c for c in (f"4{digits}{n:05d}" for n in range(7, 999)) if luhn(c))
    value = {"phone": f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", "email": f"u{digits[:3]}@mail{digits[3]}.example.com", "card": card}[kind]
    words = [rng.choice(["lorem", "ipsum", "dolor", str(rng.randrange(300)), "amet"]) for _ in range(40)]
    form = other_form(kind, value, i // 3)
    words[3:6] = ["here", value if spans else "none", "there"]
    words[29:32] = ["and", form if forms else "none", "again"]
    text = " ".join(words)
    return text, text.rfind(" and ") + 5, len(form)


def test_skip_edges_find_what_no_pattern_has(docs):
    """Precision and recall on planted mentions that the model wasn't trained on; without skip edges none is found."""
    kinds = ["phone", "email", "card"]
    rows = [(i, planted(i, kinds[i % 3], forms=False)[0]) for i in range(600)]
    model = train_pii(docs(rows))
    cut = SkipChainCRF(model.unary, model.chain, model.skip * 0)
    hits, lost, wrong, n = 0, 0, 0, 150
    for i in range(1000, 1000 + n):
        text, at, size = planted(i, kinds[i % 3])
        (base, every), = detect([text], model, SURE)
        added = [s for s in every if s not in base]
        here = lambda s: s[0] == kinds[i % 3] and s[1] < at + size and at < s[2]  # noqa: B023, E731
        hits, wrong = hits + any(map(here, added)), wrong + sum(not here(s) for s in added)
        lost += any(map(here, detect([text], cut, SURE)[0][1]))
        (base, every), = detect([planted(i, kinds[i % 3], spans=False)[0]], model, SURE)
        wrong += len(every) - len(base)
    assert hits >= 0.9 * n and wrong <= 0.05 * n and lost <= 0.05 * n


def test_secrets_have_spans_of_their_own(docs):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some words and 12 more token = \"{key()}\" ends it" if i % 2 else f"some words and 12 more count = {i} ends it") for i in range(300)]
    got = {r.doc_id: r for r in find_pii(docs(rows), train_pii(docs(rows))).collect()}
    for i, text in rows:
        assert (got[i].n_secret, got[i].spans, got[i].n_added) == (i % 2, "", 0)
        if i % 2:
            _, a, b = got[i].secrets.split(":")
            assert text[int(a) : int(b)] == text.split('"')[1]


def test_whole_operator(docs):
    rows = corpus()
    model = train_pii(docs(rows), train_docs=200)
    again = train_pii(docs(rows, partitions=5), train_docs=200)
    assert np.array_equal(model.unary, again.unary)
    for r in find_pii(docs(rows), model).collect():
        base = brute(dict(rows)[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in ("email", "ip", "card", "phone")]
    clean = redact_pii(docs(rows), model)
    assert clean.columns == docs(rows).columns and not any(brute(r.text) for r in clean.collect())


def test_awkward_rows(docs, awkward):
    rows = awkward + [(20, "x" * 50_000 + "1@a.b"), (21, "1.2.3.4" * 2000)]
    for model in (None, SkipChainCRF(np.zeros((1 << 13, 6)), np.zeros((6, 6)), np.zeros((6, 6)))):
        got = find_pii(docs(rows), model).collect()
        assert len(got) == len(rows) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert redact_pii(docs(rows), None).where("text is null").count() == 2
    assert train_pii(docs(awkward).where("doc_id = 4")) is None and find_pii(docs(rows).where("false"), None).count() == 0
