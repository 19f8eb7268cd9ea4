"""Tokenizer alignment, page text and conversation trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from html import escape

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import op11_align, op12_html, op13_trie

from .fixtures import documents, empty, frame

A_FILE, B_FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11


def spans(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def plain_alignment(rows):
    a_lib = Tokenizer.from_file(A_FILE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    alphabet, by_id = op11_align.byte_alphabet(), {i: t for t, i in a_lib.get_vocab().items()}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in by_id[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        sa, sb = spans(map(len, a_bytes)), spans(map(len, b_bytes))
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]] \
            if len(sa) < 1500 else None
        if links is None:
            owner = {k: j for j, y in enumerate(sb) for k in range(*y)}
            links = [(a[i], b[j]) for i, x in enumerate(sa) for j in sorted({owner[k] for k in range(*x)})]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = ["|".join(",".join(str(ids[i]) for i, x in enumerate(s) if lo < x[1] <= hi) for ids, s in ((a, sa), (b, sb)))
                  for lo, hi in zip([0, *cuts], cuts)] if len(cuts) < 1500 else None
        counts.update(links)
        docs.append((doc_id, len(a), len(b), len(cuts), links, groups and sha(";".join(groups))))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, na, nb, ng, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), g)
                   for d, na, nb, ng, ls, g in docs)


ODD = [(900, "<|endoftext|> and <s> </s> <unk> <0x41>"), (901, "a▁b"), (902, "\t\n  leading"), (903, "naïve 日本語 👍🏽 é"),
       (904, " "), (905, "x" * 300), (906, "\x00\x01"), (907, "don't we'll  two  spaces\n\n"), (907, "don't"), (None, "no id")]


def test_alignment_equals_plain_version(spark):
    rows = [(r[0], r[1] or "") for r in documents() if len(r[1] or "") < 9000] + ODD
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows] + [(950, None, 1, 2, "x")],
                               "doc_id long, text string, row long, pair long, `a.b` string").repartition(3)
    got = op11_align.alignment(df, A_FILE, B_FILE)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_alignment([*rows, (950, "")])


def test_alignment_of_a_long_text_a_full_memo_and_equal_codes(monkeypatch):
    one = op11_align.Aligner(op11_align.ByteLevel(A_FILE), op11_align.Pieces(B_FILE))
    few = op11_align.Aligner(one.sides[0], one.sides[1], memo=3)
    coded = op11_align.Aligner(one.sides[0], one.sides[1])
    coded.weights = coded.weights * 0     # every window has the same code
    texts = [(documents()[29][1] + " tail" * 20000).encode(), b"", b"one two one two", "é".encode() * 500]
    want = one.group(texts)
    for other in (few, coded, one):
        for name, column in other.group(texts).items():
            assert [list(x) if hasattr(x, "__len__") else x for x in column] == [
                list(x) if hasattr(x, "__len__") else x for x in want[name]]
    assert all(n == a + b - g for n, a, b, g in zip(*(want[c] for c in ("n_links", "n_a", "n_b", "n_groups"))))


def test_ranks_encode_as_the_tokenizer_file_does():
    side, library = op11_align.ByteLevel(A_FILE), Tokenizer.from_file(A_FILE)
    library.encode_special_tokens = True
    assert side.ranks is not None
    rnd = random.Random(4)
    parts = ["the", "er", "a", "x", "é", " ", "  ", "\n", "1", "'s", "'S", "...", "日本", "👍", "\t", "\u2003", "ABC", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=30)) for _ in range(3000)]
    texts += [f"a{chr(c)}a 1{chr(c)}1 {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for text, got in zip(texts, library.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert side.encode(text).tolist() == got.ids


def test_alignment_of_nothing(spark):
    assert op11_align.alignment(empty(spark), A_FILE, B_FILE).count() == 0


# --- 12

NAV = "<nav><ul><li><a href='/x'>Home</a><li><a href='/y'>About &amp; more</a></ul></nav>"


def page(article, around="{}"):
    return "<!DOCTYPE html><html><head><title>T</title><script>if(a<b)'</p>';</script></head><body>" + around.format(article)


PAGES = [
    ("http://h.example/1", page("<article><h1>One &lt; two</h1><p>First  \n para&copy;<p>Second<br>line</article>", NAV + "{}<footer>f</footer>"),
     ["One < two", "First para©", "Second", "line"]),
    ("http://h.example/2", page("<div id=main-text><p>No article&nbsp;here<table><tr><td>a<td>b</table></div>", NAV + "{}"),
     ["No article here", "a", "b"]),
    ("http://h.example/3", page("<article><p>Kept</p><section class='comments'><p>Nice!</p></section><article>me too</article></article>"),
     ["Kept"]),
    ("http://h.example/4", page("<main><p>In main<aside>side</aside><form>q <input></form></main>", "<div class='cookie-notice'>We</div>{}"),
     ["In main"]),
    ("http://h.example/5", page("<form><div class='has-sidebar'><article><header><h1>T</h1></header>x &#x41;&amp y</article></div></form>"),
     ["T", "x A& y"]),
    ("http://h.example/6", "<p>bare <b>bold <!-- no --> text", ["bare bold text"]),
    ("http://h.example/7", "a < b & c &lt;p&gt; <![CDATA[<x>]]>", ["a < b & c <p> <x>"]),
    ("http://h.example/8", "<ul><li>one<li>two<ul><li>deep</ul><li>three</ul><div hidden>no</div>", ["one", "two", "deep", "three"]),
    ("http://h.example/9", "<header>site</header><p>text</p><script>never closed", ["text"]),
    ("http://h.example/10", "<article><p>" + "long " * 30000 + "</article>", [("long " * 30000).strip()]),
    (None, "<nav>n</nav><p>no address", ["no address"]), ("odd", None, []), ("odd", "", []), ("http://h.example/12", "<nav>only", []),
]


def test_page_texts(spark):
    df = spark.createDataFrame([(i, u, h, {"k": i}, "k") for i, (u, h, _) in enumerate(PAGES)],
                               "page_id long, url string, html string, m map<string,int>, `a.b` string")
    df = df.unionByName(df.where("page_id = 2")).withColumnsRenamed({"m": "key"}).withColumn("node", F.lit(1))
    got = op12_html.main_text(df)
    rows = Counter((r["row"]["page_id"], r["text"]) for r in got.collect())
    want = Counter((i, "\n".join(t)) for i, (_, _, t) in enumerate(PAGES))
    want[2, "Kept"] += 1
    assert rows == want
    assert got.first()["row"].asDict().keys() == {"page_id", "url", "key", "a.b", "node"}


def test_unmarked_template_of_a_site_goes_and_shared_text_stays(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(rnd.choice("red blue green gray pink teal gold".split()) for _ in range(n))
    licence, top, low = words(30), "Our site", "All rights reserved"
    rows, want = [], {}
    for i in range(40):
        own = words(60)
        body = f"<p>{own}</p><p>{licence}</p>"
        rows.append((i, "http://big.example/p", f"<div><div>{top}</div><article>{body}</article><div><p>{low}</p></div></div>"))
        want[i] = f"{own}\n{licence}"
    for i in range(40, 60):     # no article: what recurs goes wherever it stands
        own = words(60)
        rows.append((i, "http://plain.example/p", f"<div><p>{top}</p><div><p>{own}</p></div><p>{low}</p></div>"))
        want[i] = own
    copy = f"<div>{words(60)}</div><p>{words(20)}</p>"
    for i in range(60, 80):     # copies of one page are one page
        rows.append((i, "http://copies.example/p", copy))
        want[i] = copy.replace("<div>", "").replace("</div><p>", "\n").replace("</p>", "")
    for i in range(80, 84):     # too few pages to tell
        rows.append((i, f"http://{i % 2}.small.example/p", f"<div>{top}</div><p>{words(60)}</p>"))
        want[i] = f"{top}\n" + rows[-1][2].split("<p>")[1][:-4]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["row"]["page_id"]: (r["text"], r["n_template_blocks"]) for r in op12_html.main_text(df).collect()}
    assert {k: t for k, (t, _) in got.items()} == want
    assert {n for k, (_, n) in got.items() if k < 60} == {2} and {n for k, (_, n) in got.items() if k >= 60} == {0}
    # Counts by plain code.
    nodes = defaultdict(set)
    for _, u, h in rows:
        sig, found = op12_html.candidates(h, op12_html.host(u))
        for node in found:
            nodes[node].add(sig)
    frame_of = spark.createDataFrame([(k, 1, p, n) for k, (_, u, h) in enumerate(rows)
                                      for p, f in [op12_html.candidates(h, op12_html.host(u))] for n in f],
                                     "key long, site long, page long, node long")
    made = {r["node"]: r["n_pages"] for r in op12_html.site_templates(frame_of, 5, 0.0).collect()}
    assert made == {n: len(s) for n, s in nodes.items() if len(s) >= 5}


def test_pages_of_nothing_and_deep_nesting(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert op12_html.main_text(df).count() == 0
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert op12_html.kept_blocks(deep, b"h", set()) == (["x"], 0)
    assert op12_html.kept_blocks("<p>" + escape("<&>\"'") * 1000, b"", set())[0] == ["<&>\"'" * 1000]


# --- 13


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            full = f"{len(role or '')}:{role or ''}{text or ''}"
            turns[conv].append((turn is not None, turn or 0, sha(full)[:32], role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
             sum(not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below) for q in below),
             sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), sha(ends))] += 1
    return out


def conversations():
    rnd = random.Random(11)
    rows = []
    for c in [*range(0, 130), *range(400, 460), 777, -3, -100, 10**15 + 7]:
        said = [(t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "yes", "no é", "", "long " * 50]))
                for t in range(rnd.choice([1, 1, 2, 3, 6, 9]))]
        rows += [(c, *s) for s in said]
    same = [(t, "user" if t % 2 else "assistant", "same") for t in range(9)]
    rows += [(c, *s) for c in range(5000, 5100) for s in same]
    rows += [(0, None, None, None), (1, None, "user", None), (2, 1, "user", "tie b"), (2, 1, "user", "tie a"), (3, 2, "x", "r"), (3, 2, "x", "r")]
    return rows + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("bits", [op13_trie.MIN_BITS, 64])
def test_trie_equals_plain_version(spark, monkeypatch, bits):
    # 64 cells: nearly all singletons look shared and go the exact way.
    monkeypatch.setattr(op13_trie, "MIN_BITS", bits)
    monkeypatch.setattr(op13_trie, "MAX_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, key long, `a.b` string")
    turns = op13_trie.numbered_turns(df.repartition(5))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    got = op13_trie.trie(op13_trie.inherited(turns, F.col("conv_id") - F.pmod("conv_id", F.lit(100)), h, 5))
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_screens_tails_and_takes_turnless_and_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    h = F.lit(2).cast("long")
    few = spark.createDataFrame([(7, 0, "user", "a"), (8, 0, "user", "b"), (8, 1, "user", "c")], schema)
    got = op13_trie.trie(op13_trie.inherited(op13_trie.numbered_turns(few), F.lit(0).cast("long"), h, 5)).collect()
    assert list(map(tuple, got)) == [(7, 0, None, 2, 0, 1, 0, sha("7,8"))]
    none = op13_trie.numbered_turns(spark.createDataFrame([], schema))
    assert op13_trie.trie(op13_trie.inherited(none, F.lit(0).cast("long"), h, 5)).count() == 0
    rows = spark.createDataFrame([(c, t, "user", f"{c if t > 1 else ''} {t}") for c in range(50) for t in range(6)], schema)
    prefixes = op13_trie.prefix_digests(op13_trie.inherited(op13_trie.numbered_turns(rows), F.col("conv_id"), F.lit(0), 5)).cache()
    deeper = prefixes.where("depth > 0")
    flags = op13_trie.screened(prefixes, op13_trie.Sketch(deeper.select("key"), deeper.count()))
    assert {(r["depth"], r["open"], r["shared"]) for r in flags.distinct().collect()} == {
        (1, True, True), (2, True, True), (3, True, False), (4, False, False), (5, False, False), (6, False, False)}
