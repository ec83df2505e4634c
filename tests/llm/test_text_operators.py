"""Token counts, host rules, licences, mixing, toxicity: odd rows and brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import host_rules, license, mixing, token_count, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    table = token_count.MergeTable(BPE)
    return lambda t: token_count.count_text(t, token_count.Counts(table), re.compile(re.escape("<|endoftext|>")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "é", "字", "👍", "'s", "1", "²", "_", "!", "\x85", "\xa0", " ", "\x1c", "<|endoftext|>", "xxxx", "Ünïcode", "\x00"]), max_size=12).map("".join))
def test_counts_equal_the_library(counter, text):
    library = Tokenizer.from_file(BPE)
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_on_odd_rows(spark, odd_docs, no_docs):
    rows = token_count.count_tokens(odd_docs, BPE).collect()
    library = Tokenizer.from_file(BPE)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_count.count_tokens(no_docs, BPE).count() == 0


def rules_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "$x", "\n", " ", "a b c d e f g h ", "line\n", "\x85", "\x0b"]), max_size=40).map("".join))
def test_rules_equal_brute_force(text):
    assert host_rules.text_counts(text) == rules_by_hand(text)


def test_rules_on_odd_rows(odd_docs, no_docs):
    rows = host_rules.rules_digest(odd_docs).collect()
    want = Counter((r.doc_id, *rules_by_hand(r.text)) for r in odd_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)
    assert host_rules.rules_digest(no_docs).count() == 0
    assert host_rules.keep_good(odd_docs).columns == odd_docs.columns
    kept = host_rules.keep_good(odd_docs, max_rate=1.0).collect()
    assert kept and all(r["__host"] == "clash" and r["__counts"] == "clash" and r["a`b"] == "clash" for r in kept)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [("bad", bad)] * 95 + [("bad", good)] * 5 + [("fine", good)] * 400 + [("tiny", bad), ("tiny", good)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    j = {r.host: r for r in host_rules.host_verdicts(host_rules.ruled(docs).select("host", host_rules.base_failed().alias("failed"))).collect()}
    assert j["bad"].host_rejected and not j["fine"].host_rejected and j["tiny"].shrunk_rate < 0.5
    assert host_rules.keep_good(docs).count() == 401


def places_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, label) for p, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "BY", "nc", "é", "-", " ", ", ", "\n", "CC BY-NC", "under the mit license", "0"]), max_size=25).map(" ".join))
def test_base_places_equal_brute_force(text):
    assert license.scan(text, license.automaton(license.PHRASES))[:5] == places_by_hand(text)


def labels_by_hand(text):
    """labels, score, permissive: phrases by a look at every word, tags by a look at every line."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [label for p, label in (license.BASE | license.NOTICES).items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    verdicts = []
    for line in re.split(r"[\r\n]", text or ""):
        for m in re.finditer(r"(?<![a-z0-9])spdx-license-identifier[ \t]*:[ \t]*", line, re.I):
            if (v := license.evaluate(line[m.end() :])) is not None:
                verdicts.append(v)
    labels = set(found).union(*(v[0] for v in verdicts))
    return ",".join(sorted(labels)), 1 - 0.5 ** (len(found) + len(verdicts)), all(v[1] for v in verdicts) if verdicts else None


NOTICE_PARTS = [*license.NOTICES, *license.BASE, "GNU", "public license", "\n", "x", "BSD 3-Clause License", "All rights, reserved", "é", "CC0 1.0 Universal"]
TAG_PARTS = ["SPDX-License-Identifier: MIT\n", "// spdx-license-identifier:MIT OR GPL-3.0-only\n", "SPDX-License-Identifier: (MIT\n", "SPDX-License-Identifier MIT\n", "# SPDX-License-Identifier : Apache-2.0 AND MPL-2.0 -->\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(NOTICE_PARTS + TAG_PARTS), max_size=12).map(" ".join))
def test_labels_and_scores_equal_brute_force(text):
    assert license.scan(text, license.automaton(license.PHRASES))[5:] == labels_by_hand(text)


def test_licenses_on_odd_rows(odd_docs, no_docs):
    rows = license.scan_licenses(odd_docs).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.base_labels is not None for r in rows)
    want = Counter((r.doc_id, *places_by_hand(r.text), *labels_by_hand(r.text)) for r in odd_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.permissive) for r in rows) == want
    assert license.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    "expression, labels, free",
    [
        ("MIT", {"mit"}, True), ("MIT OR GPL-3.0-only", {"mit", "gpl"}, True), ("MIT AND GPL-3.0-only", {"mit", "gpl"}, False),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, False), ("MIT AND (Apache-2.0 OR GPL-2.0-only)", {"mit", "apache-2", "gpl"}, True),
        ("MIT OR Apache-2.0 AND GPL-3.0-only", {"mit", "apache-2", "gpl"}, True), ("(MIT", None, None), ("AND MIT", None, None), ("MIT OR", None, None), ("", None, None),
    ],
)
def test_expressions(expression, labels, free):
    assert license.evaluate(expression) == (None if labels is None else (labels, free))


def test_tags_are_read():
    found = license.scan("// SPDX-License-Identifier: MIT OR Apache-2.0\n", license.automaton(license.PHRASES))
    assert found[5] == "apache-2,mit" and found[7] is True


def water_level(sizes, budget=1.5):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 50), s) for i in range(6000) for s in [[None, "b", "a", "ü", "c", "Z"][i % 6] if i % 3 else "hot"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = water_level(sizes)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-3) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.08 * want[s] for s in sizes)
    assert sorted(got) == sorted(mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").collect())
    assert mixing.mix(docs).select(F.sum(mixing.n_words("text"))).first()[0] == sum(taken.values())


def test_mixing_on_odd_rows(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    want, by_row = water_level(sizes), Counter()
    for r in docs:
        by_row[r.doc_id, len(re.findall(mixing.WORD, r.text or "")), sizes[r.source], round(want[r.source], 6)] += 1
    got = mixing.mix_digest(odd_docs).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, r.target) for r in got) == by_row
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"] for r in got)
    assert all(r["size"] == "clash" and r["__size"] == "clash" and r["__mix"] == "clash" for r in mixing.mix(odd_docs).collect())
    assert mixing.mix_digest(odd_docs).count() == 9 and mixing.mix_digest(no_docs).count() == 0
    assert mixing.mix(odd_docs).columns == odd_docs.columns and mixing.mix(no_docs).count() == 0


def toxic_texts(n, seed):
    words = [hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:6] for i in range(3000)]
    out = []
    for i in range(n):
        body = [words[(i * 37 + k * k * 11) % 3000] for k in range(60)]
        if i % 3 == 0:
            body[i % 60] = ["vileword", "hatefulword"][i % 2]
        out.append((i, " ".join(["the", *body]), int(i % 3 == 0)))
    return out


def test_toxicity_learns_and_holds_out(spark):
    rows = toxic_texts(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    model = toxicity.train(docs, labels)
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_gradients_equal_numerical_ones():
    rng = np.random.default_rng(1)
    how = toxicity.Training(dim=5, filters=4, widths=(1, 2, 3))
    model = toxicity.Model(
        rows={}, embedding=np.concatenate([np.zeros((1, 5)), rng.normal(0, 1, (9, 5))]),
        filters=[rng.normal(0, 1, (w, 5, 4)) for w in how.widths], bias=[rng.normal(0, 0.1, 4) for _ in how.widths], out=rng.normal(0, 1, 12), shift=0.3,
    )
    for n, y in ((7, 1), (12, 0), (2, 1), (0, 0)):
        rows = rng.integers(0, 10, (n, 2))
        got = toxicity.gradients(model, rows, y, 1.7)

        def numerical(values, at):
            old = values[at]
            out = []
            for step in (1e-5, -1e-5):
                values[at] = old + step
                out.append(toxicity.loss(model, rows, y, 1.7))
            values[at] = old
            return (out[0] - out[1]) / 2e-5

        for j in range(12):
            assert got.out[j] == pytest.approx(numerical(model.out, j), abs=1e-4)
        for k, kernel in enumerate(model.filters):
            for at in np.ndindex(kernel.shape):
                assert got.filters[k][at] == pytest.approx(numerical(kernel, at), abs=1e-4)
            for j in range(4):
                assert got.bias[k][j] == pytest.approx(numerical(model.bias[k], j), abs=1e-4)
        full = np.zeros_like(model.embedding)
        full[got.rows] = got.embedding
        for at in np.ndindex(9, 5):
            assert full[at[0] + 1, at[1]] == pytest.approx(numerical(model.embedding, (at[0] + 1, at[1])), abs=1e-4)


def test_toxicity_trains_on_odd_labels(spark):
    """Ids that are repeated with two texts, labels that contradict each other, null labels and ids, texts that are too long."""
    rows = toxic_texts(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "another and longer text of the same id " * 20), (1, None), (2, ""), (None, "x"), (3, "y " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1 - rows[0][2]), (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    seen = {}
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, y, how: seen.update(zip(texts, y)) or fit(texts, y, how)
        toxicity.train(docs, labels, how=toxicity.Training(n_positive=70, n_negative=90, most_chars=30_000, epochs=1))
    finally:
        toxicity.fit = fit
    assert 0 < sum(seen.values()) <= 70 and 0 < len(seen) - sum(seen.values()) <= 90
    assert all(sum(len(t) for t, y in seen.items() if y == k) <= 30_000 for k in (0, 1))
    assert all(t in {x for _, x, _ in rows} for t in seen)


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    rows = toxic_texts(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    nothing = toxicity.train(no_docs, labels)
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(odd_docs, nothing).collect())


def test_score_depends_on_the_text_alone(spark):
    rows = toxic_texts(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    same = spark.createDataFrame([(10_000 + i, rows[0][1]) for i in range(3)], "doc_id long, text string")
    assert len({r.score for r in toxicity.score_toxicity(same, model).collect()}) == 1
