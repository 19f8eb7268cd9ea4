"""Every operator against a plain brute-force version on a small table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import (
    op1_substring,
    op2_packing,
    op3_sentencepiece,
    op4_simhash,
    op5_token_counts,
    op6_quality,
    op7_chat,
    op8_pii,
    op9_exact_dedup,
    op10_lines,
    weak,
)
from ledgerlens.llm.graph import connected_components

from .fixtures import documents, empty, frame

WORD = re.compile("[^\x20\x09-\x0D]+")
ROWS = [(r[0], r[1] or "") for r in documents()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bag(rows):
    return Counter(map(repr, rows))


# --- 1


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(spark, window):
    words = [(d, WORD.findall(t)) for d, t in ROWS]
    seen = Counter(tuple(w[i:i + window]) for _, w in words for i in range(len(w) - window + 1))
    want = []
    for d, w in words:
        cut = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        want.append((d, len(w), len(cut), sha(" ".join(x for i, x in enumerate(w) if i not in cut))))
    got = op1_substring.Repeats(frame(spark), window).result().select("id", "n_words", "n_removed", "kept_sha256")
    assert bag(map(tuple, got.collect())) == bag(want)
    kept = op1_substring.remove_repeats(frame(spark), window)
    assert kept.columns == frame(spark).columns and kept.count() == len(ROWS)
    assert op1_substring.Repeats(empty(spark), window).result().count() == 0


def test_substring_windows_that_share_64_bits(spark):
    w = spark.createDataFrame([(1, 0, 5, 1), (2, 3, 5, 1), (3, 9, 5, 2), (4, 1, 6, 1), (4, 2, 6, 1), (5, 0, 7, 1)],
                              "row long, start int, h1 long, h2 long")
    assert sorted(map(tuple, op1_substring._repeated_windows(w).collect())) == [(1, 0), (2, 3), (4, 1), (4, 2)]


# --- 2


def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(op2_packing.word_tokenizer())
    want = []
    for d, t in ROWS:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = op2_packing.pack_documents(frame(spark), op2_packing.word_tokenizer()).collect()
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert op2_packing.pack_documents(empty(spark), op2_packing.word_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_every_piece(seed):
    rnd = random.Random(seed)
    hist = Counter(rnd.choice([rnd.randint(1, 2048), rnd.randint(1, 300), 2048, 1024]) for _ in range(4000))
    runs = op2_packing.plan(hist)
    held = Counter()
    for _, count, lengths in runs:
        assert sum(lengths) <= 2048
        for n in lengths:
            held[n] += count
    assert held == hist
    assert sum(r[1] for r in runs) <= 1.02 * sum(k * n for k, n in hist.items()) / 2048 + 2
    table = op2_packing.places(runs)
    assert len({(a, b) for a, b, *_ in table.tolist()}) == len(table)


# --- 3


def test_sentencepiece_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece
    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    want = []
    for d, t in ROWS:
        ids = library.encode(t)
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert bag(map(tuple, op3_sentencepiece.encode_digests(frame(spark), file).collect())) == bag(want)
    full = {repr(r["doc_id"]): r for r in op3_sentencepiece.encode(frame(spark), file).collect()}
    assert all(full[repr(d)]["decoded"] == library.decode(library.encode(t)) for d, t in ROWS)
    assert op3_sentencepiece.encode_digests(empty(spark), file).count() == 0


# --- 4


def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, distance=2):
    roots = {p: p for p in prints}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x
    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                roots[find(b)] = find(a)
    return {p: find(p) for p in prints}


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "PIECE", 4096)
    prints = [(d, _fingerprint(t)) for d, t in ROWS]
    roots = _components({p for _, p in prints})
    least = defaultdict(list)
    for d, p in prints:
        least[roots[p]] += [d] if d is not None else []
    want = [(d, f"{p:016x}", min(least[roots[p]], default=None)) for d, p in prints]
    assert bag(map(tuple, op4_simhash.near_duplicates(frame(spark)).collect())) == bag(want)
    assert op4_simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [2, 32])
@pytest.mark.parametrize("distance", [1, 2])
def test_simhash_links_in_dense_buckets(spark, distance, dense):
    rnd = random.Random(dense)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for c in centres for _ in range(60)}
    values |= {rnd.getrandbits(64) for _ in range(50)}
    prints = spark.createDataFrame([(i, op4_simhash._signed(v)) for i, v in enumerate(sorted(values))], "id long, fp long")
    roots = _components(values, distance)
    least = defaultdict(lambda: len(values))
    for i, v in enumerate(sorted(values)):
        least[roots[v]] = min(least[roots[v]], i)
    got = op4_simhash.components(prints, distance, dense).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: least[roots[v]] for i, v in enumerate(sorted(values))}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect() if r["node"] != r["root"]}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


# --- 5


def test_token_counts(spark):
    import public_tokenizers
    import tiktoken
    from base64 import b64decode
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    n = sorted(len(encode(t)) for _, t in ROWS)
    lengths = op5_token_counts.lengths(frame(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sums = op5_token_counts.suffix_sums(op5_token_counts.histogram(lengths), band=16).cache()
    for r in sums.collect():
        limit = r["length"]
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n) and r["total_tokens"] == sum(n)
        assert r["docs_from"] == sum(x >= limit for x in n) and r["n_docs"] == n.count(limit)
    for r in op5_token_counts.at_limits(sums, [0, 7, 64, 100000]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in n)
        assert r["docs_over"] == sum(x > r["context_limit"] for x in n)
    for r in op5_token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == n[math.ceil(len(n) * r["fraction"]) - 1]
    none = op5_token_counts.lengths(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert op5_token_counts.suffix_sums(op5_token_counts.histogram(none)).count() == 0


# --- 6


def _measures(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeat = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))


def test_quality_measures_and_verdict(spark):
    got = op6_quality.quality(frame(spark)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert bag((r["id"], *(r[c] for c in names)) for r in got) == bag((d, *_measures(t)) for d, t in ROWS)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["quality"] >= 0.5)
    kept = op6_quality.filter_documents(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == sum(r["kept"] for r in got)
    assert op6_quality.quality(empty(spark)).count() == 0


def _em(codes, start):
    """Plain version of the mixture model."""
    n, shares, chances = Counter(codes), list(start.shares), [list(t) for t in start.chances]
    patterns = sorted(n)

    def responsible(code):
        logs = [math.log(s) + sum(math.log(c if v == "1" else 1 - c) for v, c in zip(code, t) if v != "-")
                for s, t in zip(shares, chances)]
        top = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(top) for x in top]
    for _ in range(start.rounds):
        r = {p: responsible(p) for p in patterns}
        total = sum(n.values())
        mass = [sum(n[p] * r[p][k] for p in patterns) for k in range(len(shares))]
        for k, share in enumerate(start.shares):
            for j, chance in enumerate(start.chances[k]):
                yes = sum(n[p] * r[p][k] for p in patterns if p[j] == "1")
                votes = sum(n[p] * r[p][k] for p in patterns if p[j] != "-")
                held = start.pseudo + votes * (0 if k else start.anchor)
                chances[k][j] = (yes + held * chance) / (votes + held)
            shares[k] = (mass[k] + start.pseudo * share) / (total + start.pseudo)
    return {p: responsible(p)[0] for p in patterns}


@pytest.mark.parametrize("start", [weak.two_classes(3, 0.7, 0.9, 0.3), weak.one_failure_each(3, 0.8, 0.99, 0.05, 0.9, anchor=1.0)])
def test_expectation_maximisation(spark, start):
    rnd = random.Random(1)
    codes = []
    for _ in range(500):
        good = rnd.random() < 0.8
        codes.append("".join("-" if rnd.random() < 0.2 else "01"[rnd.random() < (0.95 if good else 0.3)] for _ in range(3)))
    got = weak.posteriors(spark.createDataFrame([(c,) for c in codes], "code string"), start).collect()
    want = _em(codes, start)
    assert {r["code"]: r["n"] for r in got} == Counter(codes)
    assert all(r["posterior"] == pytest.approx(want[r["code"]], abs=1e-9) for r in got)


# --- 7


def test_chat_round_trip_and_order(spark):
    ugly = ["", None, "<|im_end|><|im_start|>assistant ok", "a\\<|b<\\|c\\\\<|", "x\ny", "<", "|<\\n|"]
    rows = [(c, t, role, ugly[(c + t) % len(ugly)]) for c in range(9) for t, role in
            enumerate(["system", "user", "assistant", "user", "assistant", None, "to<|ol\n"][c % 3:3 + c % 5])]
    rows += [(None, None, "user", "hi"), (50, 0, "user", "q"), (50, 0, "user", "q"), (51, 0, "user", "q"), (51, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = op7_chat.format_conversations(df)
    back = made.select("conv_id", op7_chat.read_back(F.col("formatted")).alias("b"),
                       op7_chat.loss_text(F.col("segments")).alias("loss"), "order_error").collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["b"]] for r in back} == want
    for r in back:
        assert r["loss"] == "".join(text for role, text in want[r["conv_id"]] if role == "assistant")
    errors = {r["conv_id"]: r["order_error"] for r in back}
    assert errors[50] == 2 and errors[51] == 0 and errors[None] == 2
    assert op7_chat.format_conversations(df.limit(0)).count() == 0


# --- 8


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def _spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            out += [(m.start(), rank, m.end(), kind)] if good else []
    return sorted(out)


def test_personal_data_spans(spark):
    got = op8_pii.spans(frame(spark)).collect()
    assert bag((r["id"], [tuple(s) for s in r["base"]]) for r in got) == bag((d, _spans(t)) for d, t in ROWS)
    for r in got:
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    # The run of two cards fails as one base match; both are found as added spans.
    doc = next(d for d, t in ROWS if t.startswith("card 4111"))
    text = dict(ROWS)[doc]
    spans = next(r["spans"] for r in got if r["id"] == doc)
    assert {text[s["start"]:s["end"]] for s in spans if s["kind"] == "card"} >= {"4012888888881881"}
    assert not any("1112" in text[s["start"]:s["end"]] for s in spans)
    clean = op8_pii.redact(frame(spark))
    assert clean.columns == frame(spark).columns and clean.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "<EMAIL>" in next(t for t in texts.values() if t and t.startswith("mail")) and "4012888888881881" not in texts[doc]
    assert all(texts[d] == t for d, t in ((r[0], r[1]) for r in documents()) if not _spans(t or "") and not re.search("[0-9]{3}", t or ""))
    assert op8_pii.spans(empty(spark)).count() == 0


def test_personal_data_added_spans_leave_prose_alone(spark):
    texts = ["we looked at it.Then left at the.end", "write to jo.doe at example dot com please", "version 1 234 567",
             "call (743) 555-3824 now", "seven 743-555-3824 times"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: [texts[r["id"]][s["start"]:s["end"]] for s in r["spans"]] for r in op8_pii.spans(df).collect()}
    assert got[0] == [] and got[2] == []
    assert got[1] == ["jo.doe at example dot com"] and got[3] == ["(743) 555-3824"]


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_patterns_on_noise(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("a1.@+-_ (9)5é\n") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]
           for r in op8_pii.candidates(df).collect()}
    assert got == {i: _spans(t) for i, t in enumerate(texts)}


# --- 9


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 7}, {"chunk_bytes": 5, "primes": (3, 2), "bases": (2, 1)}])
def test_exact_dedup(spark, options):
    low = [(d, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for d, t in ROWS]
    if options.get("primes"):  # nearly every fingerprint collides: short texts keep this quick
        low = [(d, t) for d, t in low if len(t) < 400]
    groups = defaultdict(list)
    for d, t in low:
        groups[t].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = [(d, best[t], len(groups[t]), d == best[t], sha(t)) for d, t in low]
    docs = frame(spark).where(F.length(F.coalesce("text", F.lit(""))) < 400) if options.get("primes") else frame(spark)
    assert bag(map(tuple, op9_exact_dedup.exact_dedup(docs, **options).collect())) == bag(want)
    assert op9_exact_dedup.exact_dedup(empty(spark), **options).count() == 0


# --- 10


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(b))
            b[at:at + rnd.randint(0, 1)] = [rnd.choice("abé")] * rnd.randint(0, 1)
        pairs.append((a, "".join(b) or "b"))
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", op10_lines.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert all(r["w"] == (_edits(r["a"], r["b"]) <= edits) for r in got)


@pytest.mark.parametrize(("edits", "dense"), [(1, 64), (1, 1), (2, 64)])
def test_line_dedup(spark, edits, dense):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcd ") for _ in range(24)) for _ in range(6)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(3):
            x = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randint(0, len(x))
                x[at:at + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
            lines.append("".join(x))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    first = {}
    for d, t in sorted(docs):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 20:
                first.setdefault(x, (d, i))
    want = []
    for d, t in docs:
        exact, near = [], []
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 20 and first[x] != (d, i):
                exact.append(i)
            elif len(x) >= 20 and any(first[y] < (d, i) and _edits(x, y) <= edits for y in first):
                near.append(i)
        if exact or near:
            want.append((d, exact, near))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = op10_lines.removed_lines(df, edits, 20, dense).select("id", "exact", "near").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup_edge_rows(spark):
    out = op10_lines.remove_lines(frame(spark))
    assert out.columns == frame(spark).columns
    assert op10_lines.remove_lines(empty(spark)).count() == 0
    texts = [r["text"] for r in out.collect() if r["text"]]
    assert sum(x == "a line of some length here" for t in texts for x in t.split("\n")) == 1
