import random
import unicodedata

import numpy as np
import pytest

from marlstone.llm import leaks as L
from marlstone.llm.words import words

VOCABULARY = [f"w{i}x" for i in range(120)] + ["the", "of", "was", "no", "way", "to"] * 6


def text(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, stretch, edits):
    out = list(stretch)
    for at in sorted(rng.sample(range(1, len(out) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zz"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "zz")
    return out


def brute(item, document, least=25, one_in=8):
    """Edit distances of every stretch of the item against every part of the document."""
    for start in range(len(item) - least + 1):
        row = [0] * (len(document) + 1)  # a part may begin anywhere
        for i in range(start, len(item)):
            new = [row[0] + 1]
            for j, w in enumerate(document, 1):
                new.append(min(row[j - 1] + (item[i] != w), row[j] + 1, new[j - 1] + 1))
            row = new
            if i - start + 1 >= least and one_in * min(row) <= i - start + 1:
                return True
    return False


def found_in(index, texts):
    return set(L.leaks_of(index, [words(t) for t in texts]))


def test_against_brute_force():
    rng = random.Random(6)
    items = [(i, " ".join(text(rng, rng.randrange(20, 70)))) for i in range(30)]
    index = L.ItemIndex.build(items)
    documents, expected = [], set()
    for d in range(120):
        body = text(rng, rng.randrange(0, 80))
        if d % 2:
            i, own = rng.choice(items)
            own = own.split()
            n = min(len(own), rng.choice([15, 20, 23, 24, 25, 26, 30, 40]))
            at = rng.randrange(len(own) - n + 1)
            part = edited(rng, own[at : at + n], rng.choice([0, 1, 2, 3, 4, 5]))
            cut = rng.randrange(len(body) + 1)
            body = body[:cut] + part + body[cut:]
        documents.append(" ".join(body))
        expected |= {(d, i) for i, t in items if brute(t.split(), body)}
    assert found_in(index, documents) == expected
    assert len(expected) > 20


def test_wand_finds_what_scores_find(monkeypatch):
    monkeypatch.setattr("marlstone.llm.leaks.BLOCK", 2)
    rng = random.Random(3)
    phrases = [text(rng, rng.randrange(5, 9)) for _ in range(60)]  # which items share
    items = [(i, " ".join(w for _ in range(rng.randrange(5, 9)) for w in rng.choice(phrases))) for i in range(300)]
    items = [(i, t) for i, t in items if len(t.split()) >= 25]
    index = L.ItemIndex.build(items)
    skipped = 0
    for _, own in items[:150]:
        own = own.split()
        at = rng.randrange(max(1, len(own) - 40))
        passage = (text(rng, rng.randrange(30)) + edited(rng, own[at : at + 40], rng.randrange(1, 9)) + text(rng, 60))[: L.PASSAGE]
        terms = index.term_numbers(index.numbers(passage))
        asked, times = np.unique(terms[terms < len(index.terms)], return_counts=True)
        scores = np.zeros(len(index.item_ids))
        for t, n in zip(asked, times, strict=True):
            some = slice(index.start[t], index.start[t + 1])
            np.add.at(scores, index.item[some], index.gain[some].astype(float) * n)
        found = L.wand(index, asked.tolist(), times.tolist())
        assert found == np.flatnonzero(scores >= L.REACHED).tolist()
        skipped += int((scores > 0).sum()) - len(found)
    assert skipped > 100


def test_blocks_hold_the_greatest_gains():
    rng = random.Random(4)
    index = L.ItemIndex.build([(i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(30))) for i in range(500)])
    assert (np.diff(index.start) > L.BLOCK).any()
    for t in range(len(index.terms)):
        gains, blocks = index.gain[index.start[t] : index.start[t + 1]], slice(index.block[t], index.block[t + 1])
        assert index.upper[t] == gains.max() == index.most[blocks].max()
        assert index.last[blocks][-1] == index.item[index.start[t + 1] - 1]
        assert (np.diff(index.item[index.start[t] : index.start[t + 1]]) > 0).all()
    dense = [(index.terms.tolist().index(t), 1) for t in index.terms[:20].tolist()]
    assert L.wand(index, [t for t, _ in dense], [n for _, n in dense]) == sorted(set(L.wand(index, [t for t, _ in dense], [n for _, n in dense])))


def test_retrieval_loses_no_leak():
    rng = random.Random(8)
    items = [(i, " ".join(text(rng, 60))) for i in range(40)]
    index = L.ItemIndex.build(items)
    for i, t in items:
        own = t.split()
        at = rng.randrange(36)
        part = edited(rng, own[at : at + 25], 3)
        body = text(rng, rng.randrange(200)) + part + text(rng, rng.randrange(100))
        assert (0, i) in {(d, found) for d, found, _, _ in L.retrieve(index, [index.numbers(body)])}


@pytest.mark.parametrize("stretch", [25, 32, 48])
def test_least_score_is_a_lower_bound(stretch):
    rng = np.random.default_rng(0)
    impacts = rng.random(60)
    bound, width = L.least_score(impacts, stretch), stretch - L.GRAM + 1
    least = np.inf
    for _ in range(3_000):
        at = rng.integers(0, 60 - width + 1)
        window = impacts[at : at + width].copy()
        for word in rng.integers(0, stretch, stretch // 8):
            window[max(0, word - L.GRAM + 1) : word + 1] = 0
        least = min(least, window.sum())
    assert bound <= least < bound + 5


def test_thresholds_of_many_items():
    rng = np.random.default_rng(1)
    impacts = [rng.random(rng.integers(21, 90)) for _ in range(40)]
    apart = [min(L.least_score(g, n) for n in (25, 32, 40, 48) if len(g) >= n - L.GRAM + 1) for g in impacts]
    assert np.allclose(L.thresholds(impacts), apart)


def test_layout_and_spelling():
    stretch = "Der Kanal ersetzte die übrigen Module ohne jede Warnung weil es so geplant war und der geteilte Speicher behielt die geteilten Stände sehr lange noch heute".split()
    item = " ".join(stretch)
    index = L.ItemIndex.build([(1, item)])
    variants = [
        item, item.upper(), "> " + item.replace(" Module ", " Mo-\n> dule "), item.replace(" ", "\n"), item.replace(" ", " <b>", 3), unicodedata.normalize("NFD", item), item.replace("Warnung", "War\xadnu​ng"),
        item.replace(" ", "&nbsp;"), "*" + item.replace(" ", ", "), "viel davor " * 3_000 + item + " viel danach" * 3_000,
    ]
    assert found_in(index, variants) == {(i, 1) for i in range(len(variants))}
    assert found_in(index, [" ".join(stretch[:18]), None, "", " ", "."]) == set()


def test_tags_of_any_length():
    own = [f"w{i}x" for i in range(30)]
    index = L.ItemIndex.build([(1, " ".join(own))])
    for tag in ('<a href="' + "u" * 10_000 + '">', "<span " + 'data-x="y z" ' * 3_000 + "/>", "<!-- " + "other words " * 2_000 + "-->", "<p\n  class=c checked>"):
        assert found_in(index, [" ".join(own[:15]) + tag + " " + " ".join(own[15:])]) == {(0, 1)}
        assert words(f"a{tag} b") == ["a", "b"]
    assert words("if a <b, c> d or Map<String, Integer> and x <y") == ["if", "a", "b", "c", "d", "or", "map", "string", "integer", "and", "x", "y"]


def test_words():
    assert words(None) == words("") == []
    assert words("Half-written, <i>ca</i>fé&amp;bar don’t_x 3.5") == ["halfwritten", "café", "bar", "dont", "x", "3", "5"]


def test_frames(spark):
    rng = random.Random(9)
    own = [" ".join(text(rng, 40)) for _ in range(3)]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(own)] + [(7, None, 1), (8, "too short", 1), (None, own[0], 1), (9, "", 1)], "item_id bigint, text string, doc_id bigint")
    docs = spark.createDataFrame([(1, own[0], "x"), (2, own[0], "x"), (1, own[0], "x"), (3, own[1] + " " + own[2], "x"), (4, None, "x"), (None, own[1], "x"), (5, "nothing", "x")], "doc_id bigint, text string, item_id string")
    for index_chars in (L.INDEX_CHARS, 100):  # one index, and several
        found = sorted(tuple(r) for r in L.leaks(items, docs, index_chars=index_chars).collect())
        assert found == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert L.leaks(items.limit(0), docs).count() == 0
    assert L.leaks(items, docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_sequences(n):
    assert len(L.codes(np.ones(n, np.int64))) == 0


def test_edits_around_a_kept_word():
    own = [f"w{i}" for i in range(60)]
    part = [*own[:7], "zz", "w7", "zz", *own[8:21], "zz", *own[22:25]]
    dropped = [w for i, w in enumerate(own[:25]) if i not in (7, 9, 21)]
    index = L.ItemIndex.build([(1, " ".join(own))])
    for body in (part, dropped):
        assert brute(own, body)
        assert found_in(index, [" ".join(body)]) == {(0, 1)}
    assert found_in(index, [" ".join([*part[:12], "zz", *part[12:]])]) == set()


def test_equals_brute_force_with_close_edits():
    rng = random.Random(11)
    items = [(i, " ".join(text(rng, rng.randrange(25, 100)))) for i in range(6)]
    index = L.ItemIndex.build(items)
    documents, expected = [], set()
    for _ in range(60):
        i, own = rng.choice(items)
        own = own.split()
        n = min(len(own), rng.choice([25, 26, 31, 32, 40, 41, 48]))
        at = rng.randrange(len(own) - n + 1)
        part = own[at : at + n]
        close = rng.randrange(1, n - 10)
        for _ in range(n // 8 + rng.choice([0, 0, 1])):
            place = rng.randrange(close, close + 7)
            part[place : place + rng.randrange(2)] = ["zz"] * rng.randrange(2)
        body = [*text(rng, rng.randrange(90)), *part, *text(rng, rng.randrange(60))]
        documents.append(" ".join(body))
        expected |= {(len(documents) - 1, j) for j, t in items if brute(t.split(), body)}
    assert found_in(index, documents) == expected
    assert len(expected) > 25


def test_retrieval_of_edits_at_the_dearest_words():
    start, end = ([f"{x}{i}" for i in range(10)] for x in "ab")
    items = [[*start, *(f"m{k}x{i}" for i in range(12)), *end] for k in range(40)]
    index = L.ItemIndex.build([(k, " ".join(own)) for k, own in enumerate(items)])
    body = list(items[3])
    for at in (11, 14, 17, 20):  # four edits in 32 words, and in each 25 of them
        body[at] = "zz"
    assert brute(items[3], body)
    assert (0, 3) in found_in(index, [" ".join(body)])
