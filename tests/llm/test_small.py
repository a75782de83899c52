"""The text operators without Spark: against brute force, round trips and held-out accuracy."""

import itertools
import math
import random
import resource
import time

import numpy as np
import pytest

from fluxloom.llm import bpe, languages, main_text, mixing, order_minhash, pii, quality, shelf


def longest_common(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def test_banded_alignment_equals_the_full_table():
    draw = random.Random(1)
    for _ in range(1500):
        a = [draw.randrange(6) for _ in range(draw.randrange(1, 25))]
        b = list(a)
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = [draw.randrange(6)] * draw.randrange(2)
        if not b:
            continue
        common = longest_common(a, b)
        likeness = common / (len(a) + len(b) - common)
        alike, apart = order_minhash.similar(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert alike == (likeness >= 0.8 - 1e-12)
        assert apart <= len(a) + len(b) - 2 * common
        assert not alike or apart == len(a) + len(b) - 2 * common


def test_kmers_and_bands_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", None, "", "x y", " a  b c d e f g ", "the the the the the the the the"]
    hashes, counts = order_minhash.kmers(texts, 5)
    assert counts.tolist() == [3, 0, 0, 1, 3, 4]
    assert (hashes[:3] == hashes[4:7]).all() and len(set(hashes[7:].tolist())) == 1
    sketch = order_minhash.Sketch()
    together = order_minhash.bands(hashes, counts, sketch)
    for row, text in enumerate(texts):
        alone = order_minhash.bands(*order_minhash.kmers([text], 5), sketch)
        assert (alone[0] == together[row]).all()
    assert (together[0] == together[4]).all()


def test_bands_see_the_order():
    words = [f"w{i}" for i in range(200)]
    moved = words[100:] + words[:100]
    sketch = order_minhash.Sketch(tables=64, length=3)
    a, b = order_minhash.bands(*order_minhash.kmers([" ".join(words), " ".join(moved)], 5), sketch)
    # The texts share nearly all windows; a set-based sketch would agree nearly always.
    assert (a == b).mean() < 0.6


def test_languages_learn_and_split_long_texts(monkeypatch):
    encoder = languages.Encoder(256)
    texts = ["The cat sat.", None, "123 !?", "", "Ünïcode ñandú", "the cat; SAT"]
    sums, lettered = encoder.encode(texts)
    assert lettered.tolist() == [True, False, False, False, True, True]
    assert (sums[0] == sums[5]).all() and not sums[1].any()
    long = "some words of a text " * 200
    whole = encoder.encode([long])[0]
    monkeypatch.setattr(languages, "SLICE_CHARS", 97)
    monkeypatch.setattr(languages, "TRIGRAM_BLOCK", 5)
    assert (encoder.encode([long, "x"])[0][0] == whole[0]).all()
    # Against the definition, trigram by trigram.
    letter = [encoder.letter(c) for c in (0, ord("a"), ord("b"), 0)]
    expected = sum(np.roll(letter[i].astype(int), 2) * np.roll(letter[i + 1].astype(int), 1) * letter[i + 2] for i in (0, 1))
    assert (encoder.encode(["AB."])[0][0] == expected).all()


def test_patterns_equal_the_plain_expressions():
    import re

    draw = random.Random(3)
    alphabet = "a.b@-+0123456789 ()%"

    def plain(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub(r"[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                      if 8 <= len(digits(m)) <= 15]

    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        assert pii.patterns(text) == plain(text), text
    assert pii.patterns("0000000192.00000000000000000168.1.1") == plain("0000000192.00000000000000000168.1.1")
    assert pii.patterns("9" * 6000 + ".1.1.1") == []


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_finds_what_patterns_miss_and_leaves_prose(field):
    text = "call (212) 555-0143 now or write to jane (at) example (dot) com, version 2.0 of 2021-03-04"
    (base, spans), = pii.find([text], field)
    assert base == []
    found = {(kind, text[a:b]) for kind, a, b in spans}
    assert ("phone", "(212) 555-0143") in found and any(kind == "email" for kind, _ in found)
    assert all("2021" not in part and "2.0" not in part for _, part in found)
    clean = ["", None, "no numbers here", "Licensed under the License, Version 2.0.", "it has 12 parts and 7 more"]
    assert [spans for _, spans in pii.find(clean, field)] == [[]] * 5
    assert pii.redact(text, spans).count("[phone]") == 1
    assert pii.redact(None, []) is None


def test_field_keeps_pattern_spans(field):
    texts = [text for text, _ in pii.examples(2, seed=50)] + ["x +1 (569) 555-6633 y a.b@c.example z 10.0.0.1"]
    for text, (base, spans) in zip(texts, pii.find(texts, field), strict=True):
        assert base == pii.patterns(text) and set(base) <= set(spans)
    right = sum(len(set(spans) & set(want)) for (_, spans), (_, want) in zip(
        pii.find([t for t, _ in pii.examples(4, seed=77)], field), pii.examples(4, seed=77), strict=True))
    assert right / sum(len(want) for _, want in pii.examples(4, seed=77)) > 0.75


def test_viterbi_is_the_best_path(field):
    text = "tel. 030 1234567 ok"
    starts, _, shapes = pii._window(text, 0, len(text))
    five = pii._features(shapes)[:4]
    score = lambda path: sum(field.emission(f)[y] + field.between[x, y] for f, x, y in zip(five, (0, *path), path))  # noqa: E731, B905
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
    assert field.decode([five])[0] == list(best)


def test_main_text_of_layouts():
    weights = main_text.learn()
    page = lambda body: main_text.content(f"<html><body>{body}</body></html>", weights)
    assert page('<nav><a>Home</a></nav><article><h1>T</h1><p>fo<b>o</b> bar<br>baz&nbsp;&amp; x</p><div class="ad">buy</div>'
                '<p>tail</p></article><footer>foot</footer>') == "T foo bar baz & x tail"
    assert page('<main><h1>A</h1><form><input><button>Go</button></form><p>Some body text to read here.</p></main>'
                '<div id="comments"><p>a long comment with many words in it to mislead a reader of words</p></div>') \
        == "A Some body text to read here."
    assert page("<p>one</p><p>two three</p>") == "one two three"
    for broken in (None, "", "<!-- x", "<script>var x", "<p", "<<<", "</p></div>", "<style>p{}</style>", "&"):
        assert isinstance(main_text.content(broken, weights), str)
    assert main_text.content("plain &lt;b&gt; text", weights) == "plain <b> text"


def test_main_text_goes_on_after_media_and_marked_headings():
    weights = main_text.learn()
    for tag in ("<video-js></video-js>", "<svg-icon></svg-icon>", "<title-bar>", "<select-box>", "<video src='x'>", "<object>",
                "<select>", "<video><p>none</p></video>", "<svg><text>none</text></svg>"):
        page = f"<html><body><article><p>one two three</p>{tag}<p>four five six</p></article></body></html>"
        assert main_text.content(page, weights) == "one two three four five six"
    for name in ("related", "comments", "share"):
        page = f'<article><p>one two three</p><h2 class="{name}">four</h2><p id="{name}">five six</p></article>'
        assert main_text.content(page, weights) == "one two three four five six"


def test_main_text_leaves_out_parts_inside_an_article():
    weights = main_text.learn()
    for part in ('<ul class="share social"><li>x</li></ul>', '<p class="advert sponsored">x</p>', '<span class="ad">x</span>',
                 '<table class="navigation menu"><tr><td>x</td></tr></table>', '<ol class="comments"><li>x</li></ol>',
                 '<p class="ad">x y</p>', '<aside>x</aside>', '<div class="cookie notice">x</div>', "<form><label>x</label></form>",
                 '<ul id="comments"><li><p>x</p><p>y</p></li></ul>'):
        page = f"<body><nav><a>n</a></nav><article><h1>t</h1><p>one two three</p>{part}<p>four five six</p></article></body>"
        assert main_text.content(page, weights) == "t one two three four five six", part
    for part in ('<h2 class="header">x</h2>', '<p class="text">x</p>', "<ul><li>x</li></ul>", '<span class="name">x</span>',
                 '<table class="data"><tr><th class="header">x</th></tr></table>', "<b>x</b>"):
        page = f"<body><nav><a>n</a></nav><article><h1>t</h1><p>one two three</p>{part}<p>four five six</p></article></body>"
        assert main_text.content(page, weights) == "t one two three x four five six", part
    for part in ('<div id="disqus_thread">x y</div>', '<div id="gdpr">x y</div>', '<div class="hdr">x y</div>', '<div class="ftr">x y</div>'):
        assert main_text.content(f"<body><article><p>one two three</p></article>{part}</body>", weights) == "one two three", part


def test_pages_without_ends_are_read_in_linear_time():
    weights = main_text.learn()
    for part in ("<video>", "<object><svg>", "<a \"'>", "<a '\">x", "<!--", "<script>", "</video ", "<p class='x", "<<", "<div>"):
        start = time.process_time()
        main_text.content("<article><p>one two</p>" + part * 40_000, weights)
        assert time.process_time() - start < 4, part
    page = "<article><p>one two</p><p title='a>b'>three</p>" + "<video>" * 40_000 + "four</article>"
    assert main_text.content(page, weights) == "one two three four"
    assert main_text.content("<article><p>one</p><p title=\"a>two</p><p class='x'>three</p></article>", weights) == "one two three"


def test_main_text_is_the_best_run():
    """Without containers the region is the best-scoring run, as a search over all runs finds it."""
    weights = main_text.Weights({}, -2.0, {-1: -1.0, 0: 1.0, 1: 1.0})
    draw = random.Random(5)
    for _ in range(200):
        page = "".join(draw.choice(["<p>", "</p>", "<b>", "a b c ", "d "]) for _ in range(draw.randrange(1, 9)))
        row = main_text.tokens(page, {})
        scores = [-2.0 if t is None else float(t.words) for t in row]
        best = max((sum(scores[i:j]) for i in range(len(row)) for j in range(i + 1, len(row) + 1)), default=0)
        assert bool(main_text.content(page, weights)) == (best > 0)


def test_trees_learn_and_traverse():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.grow(x[:2000], y[:2000])
    assert ((forest.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    # Traversal one row at a time.
    for row in x[2000:2020]:
        total = forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            at = 0
            for _ in range(forest.depth):
                at = 2 * at + (1 if row[feature[at]] <= threshold[at] else 2)
            total += value[at]
        assert math.isclose(1 / (1 + math.exp(-total)), forest.scores(row[None])[0], rel_tol=1e-12)
    assert quality.grow(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert quality.grow(x[:8], np.ones(8)).scores(x[:1])[0] == pytest.approx(0.9)


@pytest.mark.parametrize("text", [None, "", " \n\t", "word", "Ünï " * 5000, "!!!", "a\nb\na"])
def test_statistics_are_finite(text):
    found = quality.statistics(text)
    assert len(found) == len(quality.FEATURES) and all(map(math.isfinite, found))


def test_targets_fill_to_the_cap():
    sizes = [10, 1000, 500, 0, 300]
    found = mixing.targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert found[0] == 20 and found[3] == 0 and sum(found) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s for t, s in zip(found, sizes, strict=True))
    free = [i for i in range(5) if found[i] < 2 * sizes[i]]
    weight = [3, 1, 2, 3, 1]
    assert len({round(found[i] / weight[i], 4) for i in free}) == 1


def test_splitting_tree_is_exact_and_repeats():
    quotas = np.array([1000, 3, 0, 517])
    leaves = list(mixing.split(quotas, 1, 4, 8))
    again = list(mixing.split(quotas, 1, 4, 8))
    assert [n for n, _ in leaves] == list(range(16, 32))
    assert (sum(part for _, part in leaves) == quotas).all()
    assert all((a == b).all() for (_, a), (_, b) in zip(leaves, again, strict=True))
    totals = [int(part.sum()) for _, part in leaves]
    assert max(totals) - min(totals) <= 4
    # A subtree computed by itself is the same.
    left = [part for n, part in mixing.split(quotas, 1, 1, 8)][0]
    assert all((a == b).all() for (_, a), (_, b) in zip(mixing.split(left, 2, 3, 8), leaves[:8], strict=True))


def test_packed_texts_come_back():
    for pieces in (["a", " b", "\x00", " c"], [], [" "], ["\x01", "x\x00y"], ["é", "\U0001f600"]):
        assert bpe._pieces(bpe._pack_text(pieces, "".join(pieces))) == pieces


def test_pretokens_cover_every_text():
    vocab = bpe.public_vocabulary()
    for text in ("It's  a\n\ntest…  ", " x", "日本語 🤝", "   "):
        assert "".join(vocab.words.findall(text)) == text
        ids = [i for word in vocab.words.findall(text) for i in vocab.encode_word(word)]
        assert b"".join(vocab.tokens[ids].tolist()).decode() == text




def test_readers_keep_few_files_open(tmp_path):
    """Two thousand files of arrays under a limit of 256 open files, read in any order, missing ones as empty."""
    kinds = [np.uint64, np.uint32]
    for i in range(2000):
        shelf.write(f"{tmp_path}/words-{i}", [np.arange(i % 5, dtype=np.uint64) + np.uint64(i), np.arange(3, dtype=np.uint32)])
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, limits[1]))
    try:
        held = shelf.Shelf()
        assert held.limit == 64
        for i in [*range(2000), *range(1999, 0, -7), 3]:
            keys, values = held.get(f"{tmp_path}/words-{i}", kinds)
            assert keys.tolist() == [i + k for k in range(i % 5)] and values.tolist() == [0, 1, 2]
        assert [len(a) for a in held.get(f"{tmp_path}/words-2000", kinds)] == [0, 0]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
