import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs, words
from weftgraph.llm import op7_token_output as T
from weftgraph.llm import op8_chat as C
from weftgraph.llm import op9_html_text as H
from weftgraph.llm import op10_packing as P
from weftgraph.llm.tokens import WordEncoder

TEXTS = [None, "", "   ", "The cat's <|endoftext|> ran.", "ÉCOLE é İ Σας\t\r\nx", "a\x1cb ć d e", "H̱ Ab, ab. AB ab., 12 3", "x" * 5000, "The cat's <|endoftext|> ran."]


def expected(vocabulary, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_words_encode_as_texts_do(texts):
    from weftgraph.llm.tokens import default_vocabulary

    if not hasattr(test_words_encode_as_texts_do, "e"):
        test_words_encode_as_texts_do.e = WordEncoder(default_vocabulary(), cache_bytes=2000)
    e = test_words_encode_as_texts_do.e
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


PIECES = ["a", "B", "the", "ing", "é", "É", "e\u0301", "ß", "İ", "Σ", "ς", "ſ", "я", "中", "\u200d", "🙂", "\0", "\x1c", "\x85", "\u0301", "ﬁ", "'", "'s", "'RE", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", "\n", "\t", "1", "²", "-", "...", "$", "_", "AKIA"]


def test_hard_signs_encode_as_the_library_does(vocabulary, monkeypatch):
    r = random.Random(3)
    signs = [f(chr(c)) for c in [*range(0x600), 0x1E9E, 0x2029, 0x3000, 0x1F600] for f in (lambda x: x, lambda x: "ab" + x + "Cd", lambda x: "'" + x, lambda x: x + x + " " + x + "1")]
    texts = signs + ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["y" * 5000, "a" + "." * 300]
    e = WordEncoder(vocabulary)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.merges and e.encode(texts) == want
    monkeypatch.setattr("weftgraph.llm.tokens.SLICE", 50)
    small = WordEncoder(vocabulary, cache_bytes=4000)
    assert small.encode(texts[-1000:]) == want[-1000:] and small.known.nbytes <= 4000
    assert small.encode([" ".join(texts)]) == [b"".join(want)]


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers

    e = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["The  cat's\n <|endoftext|> É", "", None]
    assert e.merges is None and e.encode(texts) == [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 50_000, 1000).astype("<u4")
    out = io.BytesIO()
    w = T.PlaneWriter(out, 64, planes)
    for a in range(0, 1000, 37):
        w.add(ids[a : a + 37].tobytes())
    w.close()
    r = T.PlaneReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert b"".join(r.stream()) == ids.tobytes() and r.read(130, 200) == ids[130:330].tobytes() and b"".join(r.stream(70)) == ids[70:].tobytes()
    empty = io.BytesIO()
    T.PlaneWriter(empty).close()
    assert list(T.PlaneReader(io.BytesIO(empty.getvalue()), len(empty.getvalue())).stream()) == []


def test_token_files(spark, vocabulary):
    r = random.Random(2)
    texts = [*TEXTS, *(words(r, r.randint(0, 300)) for _ in range(40))]
    ids = [*(50 - i for i in range(len(texts) - 2)), 7, 7]
    ids[0] = None
    given = docs(spark, texts, ids).withColumns({"part": F.lit("p"), "attempt": F.lit(1), "_h": F.lit(2), "_row": F.lit(3), "at": F.lit(4)})
    got = T.read_tokens(*T.write_tokens(given, vocabulary, block=128)).collect()
    want = expected(vocabulary, texts)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted((str(i), len(w), crc(w)) for i, w in zip(ids, want))
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert T.read_tokens(*T.write_tokens(docs(spark, [], []), vocabulary)).collect() == []


def test_packing(spark, vocabulary):
    r = random.Random(3)
    texts = [*TEXTS, *(words(r, r.randint(0, 60)) for _ in range(60)), *["same text"] * 30]
    got = P.pack(docs(spark, texts), vocabulary, limit=64).collect()
    want = expected(vocabulary, texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        ids = want[x.doc_id][x.start : x.start + x.length]
        assert crc(ids) == x.ids_crc32 and len(ids) == x.length and x.doc_tokens == len(want[x.doc_id])
        pieces[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts, most in ((pieces, 1 << 40), (sequences, 64)):
        for p in parts.values():
            at = 0
            for s, n in sorted(p):
                assert s == at
                at += n
            assert at <= most
    assert all(sum(n for _, n in pieces[i]) == len(w) for i, w in enumerate(want))
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= 1.05 * sum(map(len, want)) / 64 + 2
    assert P.pack(docs(spark, [], []), vocabulary).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=33, max_size=33))
def test_patterns_hold_every_piece_once(counts):
    h = np.array([0, *counts[1:]])
    patterns = P.shortest_pack_first(h, 32)
    held = np.zeros(33, int)
    for c, lengths in patterns:
        assert sum(lengths) <= 32
        for n in lengths:
            held[n] += c
    assert (held == h).all()
    for n, (first, _, _) in P.slots(patterns).items():
        assert first[0] == 0 and h[n] > 0


TURN = C.ChatTemplate()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "</", " ", "\n", "### Assistant: ", " </turn>\n", "x"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    e = TURN.escape(text)
    assert TURN.unescape(e) == text
    turn = TURN.mark + "User" + TURN.after + e + TURN.end
    m = TURN.turn().fullmatch(turn)
    assert m and TURN.unescape(m[2]) == text and [x.end() for x in TURN.turn().finditer(turn * 2)] == [len(turn), 2 * len(turn)]


def test_a_very_long_turn_takes_linear_memory():
    import tracemalloc

    text = ("a <b> # c </t \\ d\n" * 1_200_000)[:20_000_000]
    turn = TURN.mark + "User" + TURN.after + TURN.escape(text) + TURN.end
    tracemalloc.start()
    m = TURN.turn().fullmatch(turn)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert m and TURN.unescape(m[2]) == text and not TURN.turn().fullmatch(turn[:-1])


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "\\### User: </turn>"), (1, 3, "user", None), (2, 0, "assistant", "first"), (3, 0, None, "x"), (3, 0, None, "x"), (None, 0, "user", "u"), (4, 0, "tool?", "é"), *((5, i, ("user", "assistant")[i % 2], "w" * 300) for i in range(900))]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, valid long").repartition(5)
    got = {r.conv_id: r for r in C.read_chat(C.format_chat(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(TURN.mark + TURN.label(a) + TURN.after + TURN.escape(t) + TURN.end) for a, t in turns)
    assert {c for c, r in got.items() if r.valid} == {1, 5, None}
    assert C.read_chat(C.format_chat(df.limit(0))).collect() == []


ARTICLE = "<h1>Title &amp; more</h1><p>First  <b>bold\n</b>text.<p>A<br>B</p><ul><li>one<li>two</ul>"
WANT = "Title & more\nFirst bold text.\nA B\none\ntwo"
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy <div>now</div></div><article>{ARTICLE}</article><footer>&copy; us</footer></body>", WANT),
    (f"<body><header><p>Site</header><aside>side</aside><form><p>Name<input></form><main>{ARTICLE}<section class=comments><p>nice one</p></section></main><script>if (a<b) '</p>'</script>", WANT),
    (f"<body><div id=sidebar-left><p>x</p></div><article><div class=share>tweet</div>{ARTICLE}<footer>by me</footer></article><div class='cookie-notice'>ok?</div>", WANT),
    ("<body><ul><li><a href=1>a</a><li><a href=2>b</a></ul><div><p>Main text here, long enough.</p><p>And more.</p></div><div class=footer>f</div>", "Main text here, long enough.\nAnd more."),
    ("<article><p>cut off &amp; <b>he", "cut off & he"), (None, ""), ("", ""), ("<nav><a>x</a></nav>", ""), ("plain &lt;text&gt; 1 < 2", "plain <text> 1 < 2"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
    ("<article><p>" + "a" * 200_000 + "</article>", "a" * 200_000),
    ("<article><p>a &notin; &#233; &#x41; &am</p><!-- <p>no --><p hidden>h</p></article>", "a ∉ é A &am"),
]


def test_pages(spark):
    for page, want in PAGES:
        assert H.main_text(page) == want, page[:200]
    rows = [(i, f"u{i}", h, "t", 5) for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(tuple(r) for r in H.extract(df).collect())
    assert got == sorted([(i, f"u{i}", w, len(w)) for i, (_, w) in enumerate(PAGES)] + [(0, "u0", WANT, len(WANT))])
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", [
    *(f"<body><nav><a href=/>Home</a></nav><div class='{c}'><article>{ARTICLE}</article></div><div class='ad-1 top'>Buy</div></body>" for c in ("content has-sidebar", "no-sidebar", "comments-enabled", "elementor-widget", "widget", "modal-wrapper")),
    *(f"<body><div {a}>{ARTICLE}</div><div id='comments' class='comments-area'><p>{'so nice ' * 90}</p></div></body>" for a in ("id=discussion", "class='content has-sidebar'", "class='page-wrapper comments-enabled'")),
    f"<body><article class='post no-comments'><div class=entry-header>{ARTICLE[:25]}</div>{ARTICLE[25:]}</article></body>",
    f"<body><article><div class=header>{ARTICLE[:25]}</div>{ARTICLE[25:]}</article></body>",
    f"<body><form action=/page><div role=banner>Site</div><main>{ARTICLE}</main><div class=sidebar>x</div></form></body>",
    f"<body><div class=overlay><div class=social>like</div>{ARTICLE}</div></body>",
    f"<body><article>{ARTICLE}</article><div id=comments><article class=comment-body><p>{'so nice ' * 90}</p></article></div></body>",
])
def test_wrappers_keep_their_articles(page):
    assert H.main_text(page) == WANT


@pytest.mark.parametrize("page, want", [
    ("<body><div><p>First part.</p><div class=ad>a</div><aside>b</aside><form>c</form><p>The second part is longer.</p></div></body>", "First part.\nThe second part is longer."),
    ("<body><div><p>First part.</p><p><a href=1>a</a><p><a href=2>b</a><p><a href=3>c</a><p>The second part is longer.</p></div></body>", "First part.\nThe second part is longer."),
    (f"<body><article>{ARTICLE}</article><nav>n</nav><article><p>More of it.</p></article><footer>f</footer></body>", WANT + "\nMore of it."),
    (f"<body><div><p>Before.</p><main>{ARTICLE}</main><p>After.</p></div></body>", f"Before.\n{WANT}\nAfter."),
])
def test_all_regions_are_kept(page, want):
    assert H.main_text(page) == want


SITE = "<body><div><div>The Site</div></div><div><div><p>Est. 1990</p></div></div><div class=wrap><div class=inner>"
LONG = "<p>" + "a long line of the main text " * 5 + "</p><p>Short.</p><p>" + "and another line of it " * 6 + "</p><p>The end.</p>"
ENDS = "</div></div><div><div><div><p>All rights reserved</p></div></div></div></body>"


def test_windows_decide():
    """Nothing in this page has a name: lone lines go as their windows hold little, short lines of the text stay."""
    text = "\n".join(["a long line of the main text " * 5, "Short.", "and another line of it " * 6, "The end."]).replace(" \n", "\n")
    page = f"{SITE}<div><div>{LONG}</div></div>{ENDS}"
    assert H.main_text(page) == text
    every = "\n".join(t for t, w in H.lines_of(page) if w)
    assert every == f"The Site\nEst. 1990\n{text}\nAll rights reserved"
    adverts = "<div class=ad>a</div><div class=ads>b</div><div class=advert>c</div>"
    assert H.main_text(f"<body><div>{LONG}{adverts}<p>More.</p></div></body>") == text + "\nMore."
    assert H.main_text(f"<article>{LONG}<section id=discussion><p>D.</p></section><div class=related-work>R.</div></article><article><p>More.</p></article>") == text + "\nD.\nR.\nMore."


def brute_regions(weights):
    best = max((sum(weights[k : k + H.WINDOW]) for k in range(len(weights))), default=0)
    surge, kept, on = max(1, min(H.SURGE, best // 3)), [], False
    for k, w in enumerate(weights):
        here = sum(weights[k : k + H.WINDOW])
        on = here > 0 and (on or (here >= surge and w > 0))
        kept.append(on)
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 30, 100]), max_size=40))
def test_regions_by_brute_force(weights):
    kept = [False] * len(weights)
    for a, b in H.regions(weights):
        kept[a:b] = [True] * (b - a)
    assert kept == brute_regions(weights)
