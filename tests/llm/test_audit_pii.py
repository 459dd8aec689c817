"""The filter audit and the extraction of personal data against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from corvane.llm import filter_audit, pii

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for m in filter_audit.swaps(n):
            order[m], order[m + 1] = order[m + 1], order[m]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == len(filter_audit.swaps(n)) + 1


def _audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    rows = []
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for d, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * any(o is not None and d is not None and o < d and (x or "") == t for o, x, _ in docs)
        rows.append((source or "", fails, d in good, d in toxic))
    out, sums = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            here = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in here if f in r[1]]
                here = [r for r in here if f not in r[1]]
                sums[part, f] += len(gone)
                fail = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), step] = [len(here), len(gone), len(fail) - len(gone), sum(r[1] == f for r in fail), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "A B C", "one # two"] + [" ".join(rng.choices([f"w{i}" for i in range(n)], k=70)) for n in (10, 60, 400, 4000)]
    texts += [t.upper() for t in texts[-3:]] + [texts[-1] + " 5 % |", "É" * 40 + "AB", "x y " * 30 + "*"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b", "ü"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    got = filter_audit.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == _audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_walk_updates_two_steps_as_counted_anew():
    rng = np.random.default_rng(3)
    mask, counts = np.arange(32), rng.integers(0, 9, (3, 32))
    said, removed, sums = filter_audit.walk(mask, counts)
    assert len(set(said)) == 120 and sums.sum() == 120 * counts[0, mask > 0].sum()
    for order, steps in zip(said, removed, strict=True):
        left = np.ones(32, bool)
        for f, got in zip(order, steps, strict=True):
            hit = left & ((mask >> filter_audit.FILTERS.index(f)) & 1 == 1)
            assert (got == counts[:, hit].sum(axis=1)).all()
            left &= ~hit


def _base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


PIECES = ["a", "7", "12", "255", "256", "@", ".", "-", " ", "+", "(", ")", "é", "😀", "x_y", "\n", "4111111111111111", "%", "0003", "a@b.c", "1.2.3.4", "+1 555 0000", "[at]", ":"]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(11)
    for _ in range(20_000):
        t = "".join(rng.choices(PIECES, k=rng.randint(0, 24)))
        assert pii.base_spans(t) == _base(t), t


def test_candidates_keep_apart():
    rng = random.Random(12)
    for _ in range(5_000):
        t = "".join(rng.choices(PIECES, k=rng.randint(0, 40)))
        base = pii.base_spans(t)
        found = sorted((s, e) for _, s, e in pii.candidates(t, base))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(found)), t
        assert all(e <= s2 or e2 <= s for s, e in found for _, s2, e2 in base), t


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1(" * 100_000, "1 " * 150_000, "::" * 100_000, "(at)" * 60_000, "é1@b.c " * 30_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.perf_counter() - began < 8


def _tokens(text):
    mapped = "".join(("0" if c in "0123456789" else c.lower()) if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text)
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ ]+", mapped)]


def _bootstrapped(docs):
    """The method by dictionaries of strings, in one process."""
    occ, grams = [], collections.Counter()
    for key, text in docs:
        t = text or ""
        toks = _tokens(t)
        for n in (1, 2, 3):
            grams.update(tuple(x[2] for x in toks[i : i + n]) for i in range(len(toks) - n + 1))
        base = _base(t)
        for kind, may, s, e in [(k, 1 << k, s, e) for k, s, e in base] + [(-1, m, s, e) for m, s, e in pii.candidates(t, base)]:
            left, right = [x[2] for x in toks if x[1] <= s], [x[2] for x in toks if x[0] >= e]
            ctx = [("l", tuple(left[-n:])) for n in (1, 2, 3) if len(left) >= n] + [("r", tuple(right[:n])) for n in (1, 2, 3) if len(right) >= n]
            occ.append((key, kind, 0 if kind >= 0 else may, s, e, pii.instance(may, t[s:e]), ctx))
    edges, total = collections.Counter(), collections.Counter()
    may_of = collections.defaultdict(int)
    for _, _, may, _, _, inst, ctx in occ:
        may_of[inst] |= may
        total[inst] += may > 0
        for side, gram in ctx:
            edges[(side, gram), inst] += 1
    instances = collections.defaultdict(set)
    may_at = collections.defaultdict(int)
    for _, _, may, _, _, inst, ctx in occ:
        for p in ctx:
            instances[p].add(inst)
            may_at[p, inst] |= may
    seeds = {(o[5], o[1]): 1.0 for o in occ if o[1] >= 0}
    now = dict(seeds)
    for _ in range(pii.ROUNDS):
        top, support = collections.Counter(), collections.Counter()
        for (p, inst), n in edges.items():
            if len(instances[p]) >= pii.MIN_SUPPORT:
                for k in range(4):
                    if (inst, k) in now:
                        top[p, k] += n * now[inst, k]
                        support[p, k] += 1
        good = {pk: top[pk] / grams[pk[0][1]] for pk in top if support[pk] >= pii.MIN_SUPPORT and top[pk] / grams[pk[0][1]] >= pii.MIN_CONFIDENCE}
        reach = collections.Counter()
        for (p, inst), n in edges.items():
            for k in range(4):
                if (p, k) in good and may_at[p, inst] >> k & 1:
                    reach[inst, k, (p[0], len(p[1]))] += n * good[p, k] / total[inst]
        best = {}
        for (inst, k, _), r in reach.items():
            best[inst, k] = max(r, best.get((inst, k), 0))
        pick = {}
        for (inst, k), r in best.items():
            if (r, -k) > pick.get(inst, (0, 0)):
                pick[inst] = (r, -k)
        named = {i for i, _ in seeds}
        now = seeds | {(i, -k): r for i, (r, k) in pick.items() if r >= pii.MIN_CONFIDENCE and i not in named}
    out = collections.defaultdict(list)
    for key, kind, may, s, e, inst, _ in occ:
        fits = [(now[inst, k], -k) for k in range(4) if (inst, k) in now and may >> k & 1]
        if kind >= 0:
            out[key].append((kind, s, e))
        elif fits:
            out[key].append((-max(fits)[1], s, e))
    return {k: sorted(v) for k, v in out.items()}


def _phone(rng):
    return f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    docs = []
    for i in range(60):
        docs.append((len(docs), f"{prose(20)} please call me on {'+1 ' * (i % 4 > 0)}{_phone(rng)} {prose(9)}"))
    for i in range(20):
        docs.append((len(docs), f"{prose(6)} mail to: user{i}@host{i}.example.com or {prose(3)}"))
    for _ in range(40):
        docs.append((len(docs), f"{prose(8)} in {rng.randint(1000, 9999)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {prose(8)} the {rng.randint(10**7, 10**8)} {prose(4)}"))
    docs.append((len(docs), f"{prose(6)} mail to: jane@localhost or {prose(3)}"))
    docs.append((len(docs), f"{prose(6)} user3 [at] host3 [dot] example.com {prose(3)} paid 4111111111111111 and é😀 4111111111111111 4111111111111111"))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "no identifiers, 12 only"), (len(docs) + 3, docs[0][1]), (len(docs) + 3, docs[0][1])]
    return docs


def test_bootstrapping_equals_brute_force(spark):
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = pii.personal_data(rows).collect()
    want = _bootstrapped(docs[:-1])
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id != docs[-1][0]:
            assert [(x.kind, x.s, x.e) for x in r.spans] == want.get(r.doc_id, []), docs[r.doc_id]
    extra = {r.doc_id: [(x.kind, docs[r.doc_id][1][x.s : x.e]) for x in r.spans if not x.base] for r in got}
    assert sum(1 for i in range(60) if i % 4 == 0 and [k for k, _ in extra[i]] == [pii.PHONE]) == 15  # numbers without a plus, by their contexts
    assert not any(extra[i] for i in range(80, 120))  # dates and counts stay
    assert extra[120] == [(pii.EMAIL, "jane@localhost")]
    assert (pii.EMAIL, "user3 [at] host3 [dot] example.com") in extra[121] and sum(k == pii.CARD for k, _ in extra[121]) == 2


def test_digest_is_that_of_the_base_spans(spark):
    docs = corpus()
    for r in pii.pii_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        base = _base(docs[r.doc_id][1] or "") if r.doc_id < len(docs) else _base(docs[0][1])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
