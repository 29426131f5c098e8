"""Token operators against the libraries whose results they must give."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import bytebpe, tokencount, tokenstore
from kinfold.session import ship

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("ids", T.StringType())])
ALPHABET = "ab eE\n\t  é中　́{}()\"';/*\r<>x01 _\U0001F600\x00▁ﬁstldrevm.,²"


def some_texts(n=300):
    rng = random.Random(4)
    fixed = ["", " ", "\n\n", "a" * 5000, "<|endoftext|> it's I'LL we've", "<s> <unk> <0x0A>", "x" * 9000, " " * 400, "▁▁ ▁", "ÀÉ õ " * 50]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(some_texts())] + [(9000, None, None, None), (9001, "same", "x", "x"), (9001, "same", "x", "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_token_counts(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))
    got = tokencount.count_tokens(docs, vocab.path("piece_bpe_32k.model"), limit=100).collect()
    want = sorted(((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 100) for r in docs.collect()))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokencount.count_tokens(docs.limit(0), vocab.path("piece_bpe_32k.model")).count() == 0


def test_heap_merges_match_repeated_search():
    rng = random.Random(2)
    rank = {"".join(p): i for i, p in enumerate([("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aba", "ab"), ("b", "b")])}
    for _ in range(500):
        symbols = rng.choices("ab", k=rng.randint(0, 12))
        plain, made = list(symbols), 0
        while True:
            best = min(((rank[x + y], i) for i, (x, y) in enumerate(zip(plain, plain[1:])) if x + y in rank), default=None)
            if best is None:
                break
            plain[best[1] : best[1] + 2] = [plain[best[1]] + plain[best[1] + 1]]
            made += 1
        assert tokencount.merges_made(symbols, rank) == made


def test_byte_bpe(spark, docs):
    import tiktoken

    path, pattern = vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id or -1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bytebpe.digests(docs, path, pattern).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    back = bytebpe.decode(bytebpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(bytes(r.text_bytes) for r in back) == sorted((r.text or "").encode() for r in docs.collect())
    assert bytebpe.digests(docs.limit(0), path, pattern).count() == 0


def test_pair_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (4000, 2)), axis=0).astype(np.int32)
    table = bytebpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    assert (table.find(np.array([400, -1, 5]), np.array([1, 2, -1])) == bytebpe.NONE).all()


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    store = tokenstore.write_store(docs, vocab.path("word_bpe_49k.json"), shard_chars=800)
    got = tokenstore.read_store(store).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert store.count() > 3
    assert tokenstore.read_store(tokenstore.write_store(docs.limit(0), vocab.path("word_bpe_49k.json"))).count() == 0


def test_token_store_forgets_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenstore.PartEncoder, "MOST", 20)
    code = tokenstore.PartEncoder(vocab.path("word_bpe_49k.json"))
    texts = ["plain words, and 12 more", "it's THE élan\tof it", "中 é", "", "words <|endoftext|>"] * 30
    builder, got = tokenstore._Builder(code), []
    for i, text in enumerate(texts):
        builder.add(i, text)
        if i % 7 == 6:
            shard = tokenstore.Shard(builder.finish()[2])
            got += [shard.document(k).tolist() for k in range(7)]
    assert got == [[*code.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts[: len(got)]]


def test_parts_are_those_of_the_pattern():
    """Cut points and numbers against the pattern applied text by text, and against the library."""
    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9 \t\n]+")
    rng, code = random.Random(11), tokenstore.PartEncoder(vocab.path("word_bpe_49k.json"))
    fixed = ["", "it's 'RE'll 'sample ''s --'s x'S't'd've'l", "'", "a'", "'s", "12ab34", "é's À'T", "\t\n ", "x" * 40 + " " + "x" * 41 + " " + "x" * 16 + " " + "x" * 17]
    for texts in (fixed, [], [""], ["".join(rng.choices("ab rstmdvel'''19.-\t\néÉß", k=rng.randint(0, 40))) for _ in range(2000)]):
        numbers, counts = code.numbers(texts)
        want = [pattern.findall(t.lower()) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        names = {n: part for part, n in code.items()}
        assert [names[n] for n in numbers.tolist()] == [x for w in want for x in w]


def test_parts_are_coded_once_over_many_shards():
    """A worker codes a part once for 250,000 different parts, and remembers them in few bytes."""
    code, coded = tokenstore.PartEncoder(vocab.path("word_bpe_49k.json")), []
    builder, tokenize = tokenstore._Builder(code), code.tokenize
    code.tokenize = lambda part: coded.append(part) or tokenize(part)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(250_000)]
    for at in (0, 125_000, 0, 125_000):
        builder.add(at, " ".join(words[at : at + 125_000]))
        shard = tokenstore.Shard(builder.finish()[2])
        assert shard.ids()[:2000].tolist() == code.tokenizer.encode(" ".join(words[at : at + 2000]), add_special_tokens=False).ids[:2000]
    assert len(coded) == len(set(coded)) == len(code) == 250_000
    assert sum(x.nbytes for x in (code.mixed, code.low, code.high, code.number)) < 30 * len(code)


@pytest.mark.parametrize("odd", [0, 1, 1 << 56, 1 << 61])
def test_parts_with_equal_mixes(odd, monkeypatch):
    """A mix under which many parts collide, within a shard and with those of earlier ones, changes no result."""
    monkeypatch.setattr(tokenstore, "_ODD", np.uint64(odd))
    code, rng = tokenstore.PartEncoder(vocab.path("word_bpe_49k.json")), random.Random(odd % 1000)
    builder = tokenstore._Builder(code)
    for _ in range(30):
        texts = ["".join(rng.choices("abé 19.'s", k=rng.randint(0, 40))) for _ in range(20)] + ["x" * rng.randint(14, 19)]
        for i, text in enumerate(texts):
            builder.add(i, text)
        shard = tokenstore.Shard(builder.finish()[2])
        assert [shard.document(i).tolist() for i in range(21)] == [[*code.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    code.MOST_LONG = 0
    builder.reset()
    assert len(code) == 0 == len(list(code.items()))
    code.MOST_IDS = 10
    builder.add(1, "a few long parts " + "xyz" * 40)
    builder.finish()
    assert len(code) == 0 and len(code.ids) == 1


def test_random_access():
    rng = np.random.default_rng(3)
    words = [np.array([tokenstore.END]), *(rng.integers(2, 30, rng.integers(1, 6)) for _ in range(40))]
    order = np.concatenate([np.append(rng.integers(1, 41, 50), 0) for _ in range(60)])
    plain = np.concatenate([words[i] for i in order])
    tokens = np.diff(np.concatenate([[0], np.nonzero(plain == tokenstore.END)[0] + 1]))
    rules, sequence = tokenstore.repair(words, order, base=64)
    assert len(rules) and len(sequence) < len(plain)
    shard = tokenstore.Shard(tokenstore.pack(rules, sequence, tokens, 64))
    assert (shard.ids() == plain).all()
    for a, b in rng.integers(0, len(plain), (50, 2)):
        assert (shard.ids(int(a), int(b)) == plain[a:b]).all()
    assert (shard.document(7) == plain[tokens[:7].sum() : tokens[:8].sum()]).all()


def test_extra_columns_stay_out(spark, docs):
    assert set(tokencount.count_tokens(docs.withColumn("n_bytes", F.lit(1)), vocab.path("piece_bpe_32k.model")).columns) == {"doc_id", "n_bytes", "n_tokens", "over_limit"}


def test_repair_leaves_no_frequent_pair():
    """Left to right, without overlap, no pair is found MIN_COUNT times in the final sequence; runs of one id shrink too."""
    rng = np.random.default_rng(8)
    cases = [([[1], [7]], [1] * 100_000 + [0]), ([[1], [7, 8, 9]], [1] * 100_000 + [0]), ([[1], [7] * 100_001], [1, 0])]
    words = [[1], *(rng.integers(2, 20, rng.integers(1, 6)).tolist() for _ in range(60))]
    cases += [(words, np.concatenate([np.append(rng.integers(1, 61, 40), 0) for _ in range(80)]).tolist()), (words, [*rng.integers(0, 61, 3000).tolist(), 0])]
    for words, order in cases:
        arrays, order = [np.array(w) for w in words], np.array(order)
        plain = np.concatenate([arrays[i] for i in order])
        rules, sequence = tokenstore.repair(arrays, order, base=64)
        tokens = np.diff(np.concatenate([[0], np.nonzero(plain == tokenstore.END)[0] + 1]))
        assert (tokenstore.Shard(tokenstore.pack(rules, sequence, tokens, 64)).ids()[: len(plain)] == plain).all()
        counts, last = {}, {}
        for i, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist())):
            if tokenstore.END not in pair and last.get(pair) != i - 1:
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = i
        assert max(counts.values(), default=0) < tokenstore.MIN_COUNT
    for words, order in cases[:3]:
        assert len(tokenstore.repair([np.array(w) for w in words], np.array(order), base=64)[1]) < 40


def test_ranges_expand_only_what_they_cover(monkeypatch):
    words = [np.array([1]), np.arange(2, 60)]
    order = np.array(([1] * 40 + [0]) * 200)
    rules, sequence = tokenstore.repair(words, order, base=64)
    tokens = np.full(200, 40 * 58 + 1)
    shard = tokenstore.Shard(tokenstore.pack(rules, sequence, tokens, 64))
    seen = []
    sizes = tokenstore.Shard._sizes
    monkeypatch.setattr(tokenstore.Shard, "_sizes", lambda self, symbols: seen.append(len(symbols)) or sizes(self, symbols))
    assert shard.ids(200_000, 200_010).tolist() == shard.ids()[200_000:200_010].tolist()
    assert max(seen[:20]) <= 2 * tokenstore.STRIDE


def test_the_way_by_parts_needs_the_vocabulary_it_was_made_for(tmp_path):
    import json

    path = vocab.path("word_bpe_49k.json")
    code = tokenstore.PartEncoder(path)
    assert code.by_part
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    form["normalizer"] = {"type": "NFC"}
    with open(tmp_path / "other.json", "w", encoding="utf-8") as f:
        json.dump(form, f)
    other = tokenstore.PartEncoder(str(tmp_path / "other.json"))
    assert not other.by_part and not other.safe("plain words")


def test_long_pre_tokens_are_rows_of_a_matrix():
    import tiktoken

    path = vocab.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, code = random.Random(6), bytebpe.ByteBpe(path, vocab.PATTERN)
    texts = ["a" * 30_001, "ab" * 9000 + "a", "".join(rng.choices("abcdefghij", k=20_000)), "".join(rng.choices("=-_", k=6000)), "é" * 5000, "aaab" * 3000] + ["".join(rng.choices(rng.choice(["ab", "aeiou", "thean"]), k=rng.randint(60, 400))) for _ in range(200)]
    for text, ids in zip(texts, code.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_pre_tokens_on_arrays_are_those_of_the_pattern():
    code, rng = bytebpe.ByteBpe(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN), random.Random(16)
    assert vocab.PATTERN == bytebpe.ARRAYS
    alphabets = ["'srevtmldaz ", "a1 '\n\t.", ALPHABET + "\0\x0b\x0c\x1c\x1f\x85\xa0\u2028\u3000²½Ⅷ٣ªß", "ab '\0"]
    texts = ["", "", "'s", "'", "'l", " ", "'ll've 'd''s's \n's", "a  \n b ", "\0", "\0\0", *["".join(rng.choices(a, k=rng.randint(0, 40))) for a in alphabets for _ in range(2000)], "'r", "\n"]
    for batch in (texts, [t for t in texts if t.isascii()], [""]):
        data, starts, ends, last = code._pre_tokens(batch)
        got, begin = [data[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], 0
        for text, end in zip(batch, last.tolist(), strict=True):
            assert got[begin:end] == code.pattern.findall(text)
            begin = end
    assert code.encode_batch([]) == []
    other = bytebpe.ByteBpe(vocab.path("byte_bpe_50k.tiktoken"), f"(?:{vocab.PATTERN})")  # the same matches, found by the pattern
    assert other.classes is None and other.encode_batch(texts) == code.encode_batch(texts) and other.encode_batch([""]) == [b""]


def test_memo_is_asked_once_for_equal_pre_tokens():
    """The cost of a batch follows its distinct pre-tokens; the memo is bounded, and no bound changes a result."""

    class Asked(dict):
        times = 0

        def get(self, *args):
            self.times += 1
            return super().get(*args)

    path, rng = vocab.path("byte_bpe_50k.tiktoken"), random.Random(17)
    code = bytebpe.ByteBpe(path, vocab.PATTERN)
    words = ["".join(rng.choices("aehinst\0ü", k=rng.randint(1, 15))) for _ in range(100)]
    texts = [" ".join(rng.choices(words, k=500)) + "x" * 100 for _ in range(40)]
    code.number = Asked()
    want = code.encode_batch(texts)
    found = [x for t in texts for x in code.pattern.findall(t)]
    assert code.number.times <= len({x for x in found if len(x.encode()) <= 16}) + sum(len(x.encode()) > 16 for x in found) < len(found) / 20
    assert len(code.number) == len(code.ends) and max(map(len, code.number)) <= code.LONG and code.ends[-1] == len(code.ids)
    assert code.encode_batch(texts) == want
    code.MOST = 10
    assert [x for t in texts for x in code.encode_batch([t])] == want and len(code.number) <= 10
    assert b"".join(map(code.decode, want)) == "".join(texts).encode()


def test_merges_of_lower_rank_go_first():
    """A made-up vocabulary in which a merged id takes part in pairs of lower rank, against repeated search."""
    rng = random.Random(7)
    for _ in range(60):
        tokens = ["a", "b", "c"]
        for _ in range(25):
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in tokens and len(new) < 7:
                tokens.append(new)
        tail = tokens[3:]
        rng.shuffle(tail)
        rank = {t.encode(): i for i, t in enumerate(["a", "b", "c", *tail])}
        code = object.__new__(bytebpe.ByteBpe)
        code.rank = rank
        splits = np.array([(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank], np.int32).reshape(-1, 3)
        code.pairs, code.byte_id = bytebpe.PairTable(*splits.T), np.array([rank.get(bytes([b]), 0) for b in range(256)], np.int32)
        code.first = bytebpe.early(*splits.T, len(rank))
        rows = ["".join(rng.choices("abc", k=rng.randint(2, 90))).encode() for _ in range(20)]
        want = []
        for row in rows:
            parts = [row[i : i + 1] for i in range(len(row))]
            while True:
                best = min(((rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            want.append([rank[p] for p in parts])
        for merge in (code._merge_rows, code._merge_wide_rows):
            assert [x.tolist() for x in merge(rows, 96)] == want


def test_memo_is_bounded():
    from kinfold.llm.textcache import Memo

    memo = Memo(len, 100_000)
    for i in range(5000):
        assert memo[f"key{i}"] == len(f"key{i}") and memo["x" * 500 + str(i)] == 500 + len(str(i))
        memo.trim()
        assert len(memo) + len(memo.older) < 2 * 100_000 / Memo.ENTRY and not any(len(k) > Memo.LONG for k in memo)


def test_any_column_names(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "some words", 2)], "`a.id` long, `b.text` string, `c.d` int")
    names = {"id_col": "a.id", "text_col": "b.text"}
    assert tokencount.count_tokens(docs, vocab.path("piece_bpe_32k.model"), **names).count() == 1
    assert bytebpe.digests(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, **names).count() == 1
    assert tokenstore.read_store(tokenstore.write_store(docs, vocab.path("word_bpe_49k.json"), **names)).first().doc_id == 1
