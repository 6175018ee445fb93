"""The classifiers of ops 1 and 2 against plain loops: features, weights and scores."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docmd.llm import langid, toxicity

TEXTS = ["Rye bread, rye!", "ÜBER schön - für 9 Öfen", "", None, "語 語", "x", "a1 b2 c3 a1 b2 c3 a1", "no-break " * 50]


def places(text):
    """The n-grams of op 1 of a text, by their definition: pairs and triples of bytes, letters lower-cased, others as blanks."""
    b = [c | 32 if chr(c).isalpha() and c < 128 else c if c >= 128 else 32 for c in (text or "").encode()]
    mul = lambda *pairs: sum(x * y for x, y in pairs)
    two = [(mul((p, 0x9E3779B1), (q, 0x85EBCA77)) + 0x27D4EB2F & 0xFFFFFFFF) >> 32 - langid.BITS for p, q in itertools.pairwise(b)]
    three = [(mul((p, 0xC2B2AE3D), (q, 0x9E3779B1), (r, 0x165667B1)) & 0xFFFFFFFF) >> 32 - langid.BITS for p, q, r in zip(b, b[1:], b[2:], strict=False)]
    return two + three


def vector(text, idf):
    count = {}
    for p in places(text):
        count[p] = count.get(p, 0) + 1
    own = {p: (1 + math.log(n)) * idf[p] for p, n in count.items()}
    length = math.sqrt(sum(x * x for x in own.values()))
    return {p: x / length for p, x in own.items()} if length else {}


def test_language_scores(spark):
    r = random.Random(3)
    make = lambda words: " ".join(r.choice(words) for _ in range(r.randint(8, 30)))
    kinds = {"de": "über schön größe für möchte brot ofen".split(), "en": "over nice size for would bread oven".split(), "xx": ["語", "文", "字 本"]}
    rows = [(k, make(words), lang) for k, (lang, words) in enumerate([x for x in kinds.items() for _ in range(30)])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    # inverse document frequencies over the sample, which is all rows here
    seen = {}
    for _, t, _ in rows:
        for p in set(places(t)):
            seen[p] = seen.get(p, 0) + 1
    idf = [math.log((1 + len(rows)) / (1 + seen.get(p, 0))) + 1 for p in range(langid.DIM)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    # every centroid is as long as a text's vector, and near to texts of its language
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and {model.languages[o] for o in model.owner} == set(kinds)
    texts = TEXTS + [t for _, t, _ in rows]
    names, scores, rejected = langid.classify(model, pa.array(texts))
    for text, name, score, gone in zip(texts, names, scores, rejected, strict=True):
        if not any(map(str.isalpha, text or "")):
            assert (name, score, gone) == ("und", 0.0, True)
            continue
        v = vector(text, idf)
        cosines = [sum(x * float(c[p]) for p, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert score == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-4)
        assert name == model.languages[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4
        # the floor between two lengths, on the logarithm of the bytes
        sizes, f = langid.LENGTHS, model.floors[model.owner[best]]
        at = min(max(len(text.encode()), sizes[0]), sizes[-1])
        k = max(i for i, s in enumerate(sizes) if s <= at)
        part = 0 if k + 1 == len(sizes) else (math.log(at) - math.log(sizes[k])) / (math.log(sizes[k + 1]) - math.log(sizes[k]))
        floor = f[k] if part == 0 else f[k] * (1 - part) + f[k + 1] * part
        assert gone == (score < floor) or abs(score - floor) < 1e-6


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower() if (text or "").isascii() else bytes(c | 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def named(text):
    w = words(text)
    return [("word", x) for x in w] + [("pair", *x) for x in itertools.pairwise(w)] + [("skip", a, b) for a, b in zip(w, w[2:], strict=False)]


def test_toxicity_features():
    """Equal words, pairs and skipped pairs have one place; different ones, here, have different ones."""
    of_name = {}
    for found, owners, n in toxicity.features(pa.array(TEXTS)):
        assert n == len(TEXTS)
        for i, text in enumerate(TEXTS):
            own = sorted(found[owners == i].tolist())
            assert len(own) == len(named(text))
    for text in TEXTS:
        for k in range(len(words(text))):
            w = words(text)[k : k + 3]
            (found, _, _) = next(iter(toxicity.features(pa.array([b" ".join(w).decode("utf-8", "surrogateescape")]))))
            for name, place in zip([("word", x) for x in w] + [("pair", *x) for x in itertools.pairwise(w)] + [("skip", a, b) for a, b in zip(w, w[2:], strict=False)], found.tolist(), strict=True):
                assert of_name.setdefault(name, place) == place
    assert len(set(of_name.values())) == len(of_name)


def plain_ftrl(x, y, alpha, beta, l1, l2, epochs, order):
    z, n = {}, {}
    weight = lambda f: 0.0 if abs(z.get(f, 0)) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            w = {f: weight(f) for f in x[i]}
            g = 1 / (1 + math.exp(-min(max(sum(w.values()), -35), 35))) - y[i]
            for f in x[i]:
                sigma = (math.sqrt(n.get(f, 0) + g * g) - math.sqrt(n.get(f, 0))) / alpha
                z[f] = z.get(f, 0) + g - sigma * w[f]
                n[f] = n.get(f, 0) + g * g
    return {f: weight(f) for f in z}


def test_toxicity_weights_and_scores(spark):
    r = random.Random(11)
    mild = ["river", "stone", "cloud", "bread", "green", "paper"]
    rows = [(i, " ".join([*(r.choice(mild) for _ in range(r.randint(1, 25))), *(["vile", "wretch"] if i % 4 == 0 else [])])) for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bias = 1 << toxicity.BITS
    sets = []
    for (_, text), (_, y) in zip(rows, labels, strict=True):
        (found, _, _) = next(iter(toxicity.features(pa.array([text]))))
        own = np.append(np.unique(found), bias)
        sets.append((y, len(own), own.tobytes(), own.tolist()))
    sets.sort(key=lambda s: s[:3])
    weights = plain_ftrl([s[3] for s in sets], [s[0] for s in sets], 1.0, 1.0, 1.5, 1.0, 4, np.random.default_rng(7))
    plain = {f: w for f, w in weights.items() if w and f != bias}
    assert sorted(plain) == model.places.tolist()
    assert np.allclose([plain[f] for f in model.places.tolist()], model.weights, atol=1e-5) and model.bias == pytest.approx(weights[bias], abs=1e-6)
    texts = [t for _, t in rows] + TEXTS
    for text, score in zip(texts, toxicity.scores(model, pa.array(texts)), strict=True):
        (found, _, _) = next(iter(toxicity.features(pa.array([text]))))
        total = sum(plain.get(f, 0.0) for f in set(found.tolist())) + weights[bias]
        assert score == pytest.approx(1 / (1 + math.exp(-min(max(total, -35), 35))), abs=1e-5)
