"""Text operators against brute force, round trips and libraries, with nulls, empty and repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import tokenizers

sys.path.insert(0, str(Path(__file__).parent.parent.parent / "tools"))

import check_oracles  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
    bpe, chat, decontaminate, line_dedup, lm_score, minhash, quality, suffix_dedup, token_counts, token_files,
)
from tidemark.llm.common import id_and_text, text_slices  # noqa: E402
from tidemark.llm.components import components  # noqa: E402
from tidemark.llm.oracles import ORACLES  # noqa: E402
from tidemark.llm.words import store_words, word_hashes  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "a", "The same line of more than forty characters, found in many documents.\nown", "x" * 3000, "é\n\n  日本 <|endoftext|> it's 12", "a b c d e " * 30]


def documents(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "no id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    return df if extra else df.select("doc_id", "text")


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    verdict = check_oracles.compare(spark, check_oracles.connect(FOLDER), FOLDER, name)
    assert verdict.startswith("equal"), verdict


@pytest.mark.parametrize("call", [
    quality.judge, quality.keep_good, line_dedup.keep_bitmaps, line_dedup.drop_lines, minhash.near_duplicates, minhash.keep_one,
    suffix_dedup.remove_repeats, lm_score.score_documents, lambda d: bpe.round_trip(d, RANKS, PATTERN),
])
def test_empty_table(spark, call):
    assert call(documents(spark).limit(0)).count() == 0


def test_quality_keeps_columns_and_judges_each_row(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    df = documents(spark, [good, good, *TEXTS])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 6}
    repeated = {r.doc_id: r.n_repeat_words for r in quality.judge(documents(spark, extra=False)).collect()}
    assert repeated[0] == 0 and repeated[7] == 150


def test_lines_are_kept_in_the_largest_document(spark):
    line = "A Line shared by Many documents, longer than forty."
    texts = [f"{i}\n {line.upper() if i % 2 else line}\t\n{line}\nlast" for i in range(6)]
    df = documents(spark, [*texts, *TEXTS])
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert [out[i] for i in range(5)] == [f"{i}\nlast" for i in range(5)] and out[5] == texts[5]
    assert [out[6 + i] for i in range(len(TEXTS))] == TEXTS
    assert line_dedup.drop_lines(df).columns == df.columns


def test_line_bitmap_far_into_a_text(spark):
    line = "z" * 45
    text = "\n".join([*map(str, range(500)), line, "end"])
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert out[0] == text.replace(line + "\n", "") and out[4] == text


def test_chats_round_trip(spark):
    texts = [None, "", "<|im_end|>\n<|im_start|>user\n", "<", "|", "<||", "<|turn|>", "é<|nl|>", "a\nb"]
    roles = ["user", "assistant", None, "odd\nrole<|"]
    r = random.Random(2)
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [rows[0], (None, 0, "user", "x"), (99, None, "assistant", "y"), (99, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    got = {x.conv_id: (x.turns, x.loss) for x in formatted.select(
        "conv_id", chat.read_back(formatted.formatted).alias("turns"),
        chat.read_loss(formatted.formatted, formatted.loss_spans).alias("loss"),
    ).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in v[0]] for c, v in got.items()} == want
    assert {c: v[1] for c, v in got.items()} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}


def test_tree_encoding_equals_the_library(library):
    model = bpe.ByteBPE(bpe.read_ranks(RANKS), PATTERN)
    r = random.Random(4)
    alphabet = ["a", "b", "the", "ing", " ", "\n", "é", "日", "!", "12", "'s", "\xa0", "x" * 40]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(500)] + ["ab" * 2000, "\n" * 999, "a" * 3001]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert model.encode(text) == ids and model.decode(np.array(ids, "<u4")) == text.encode()


def test_encoded_documents_token_files_and_counts(spark, library, tmp_path):
    texts = [*TEXTS, "\n\n x", "a  b\n c", TEXTS[4]]
    df = documents(spark, texts)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: library.encode_ordinary("no id here")}
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    assert {k: v.ids_sha256 for k, v in got.items()} == {k: hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest() for k, v in want.items()}
    encoded = bpe.encode_documents(df, RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_documents(encoded, RANKS).collect()} == {
        **{i: t or "" for i, t in enumerate(texts)}, None: "no id here"}

    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), path)
    found = token_files.read_index(spark, path).join(token_files.checksums(spark, path), ["part", "row"]).collect()
    at, model = 0, tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spelt = {k: model.encode(t or "", add_special_tokens=False).ids for k, t in {**dict(enumerate(texts)), None: "no id here"}.items()}
    assert 50256 in spelt[6] and 50256 not in want[6]  # a control string in the text
    for row in sorted(found, key=lambda r: r.start):
        ids = [*spelt[row.doc_id], 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)

    flat = str(tmp_path / "flat")
    token_counts.flat_files(df, RANKS, PATTERN, flat, block_ids=7)  # most documents cross blocks
    files = spark.read.parquet(flat)
    counts = token_counts.count_tokens(files).join(token_counts.labels(files), ["file", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {k: len(v) for k, v in want.items()}


def test_encoder_equals_the_library_on_any_blanks():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    encoder = token_files.library_encoder(Path(path).read_text())
    r = random.Random(5)
    signs = [*" \n\t　 ab1,.'sé\x1c\x85", "<|endoftext|>", " the", "  ", "x" * 150]
    texts = ["", " ", "a  <|endoftext|> b", *("".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(800))]
    for _ in range(2):  # new words, then words it knows
        for i, j in text_slices(pa.array(texts), 300, 5000):
            ids, first = encoder.encode(pa.array(texts).slice(i, j - i))
            for k, t in enumerate(texts[i:j]):
                assert ids[first[k] : first[k + 1]].tolist() == model.encode(t, add_special_tokens=False).ids


def test_token_files_have_small_groups_and_page_indexes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(token_files.WRITE_OPTIONS, "parquet.block.size", str(64 << 10))
    monkeypatch.setitem(token_files.WRITE_OPTIONS, "parquet.page.size", str(4 << 10))
    path = str(tmp_path / "tokens")
    docs = [(i, " ".join(f"w{(i * 31 + k) % 97}" for k in range(400))) for i in range(1500)]
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), path)
    files = [pq.ParquetFile(f).metadata for f in Path(path).glob("*.parquet")]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert max(m.num_row_groups for m in files) > 1 and all(c.has_column_index and c.has_offset_index for c in columns)
    encodings = {c.path_in_schema.split(".")[0]: set(c.encodings) for c in columns}
    assert encodings["ids"] & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} and "DELTA_BINARY_PACKED" in encodings["row"]
    some = token_files.read_documents(spark, path, 700, 702).collect()
    assert sorted(r.doc_id for r in some) == [700, 701, 702]
    assert {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in some}.items() <= {
        r.doc_id: r.ids_crc32 for r in token_files.read_index(spark, path).join(token_files.checksums(spark, path), ["part", "row"]).collect()
    }.items()


def test_flat_files_refuse_a_large_vocabulary(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "END_ID", 70_000)
    with pytest.raises(ValueError):
        token_counts.flat_files(documents(spark), RANKS, PATTERN, str(tmp_path / "flat"))


def test_tokens_after_the_last_end_id_count(spark):
    block = lambda *ids: np.array(ids, "<u2").tobytes()
    files = spark.createDataFrame([(0, 0, block(1, 2)), (0, 1, block(9, 9)), (0, 2, block(3)), (0, 3, None), (1, 0, block(9))], "file int, block long, payload binary")
    assert as_rows(token_counts.count_tokens(files, end_id=9), "file", "ordinal", "n_tokens") == [(0, 0, 2), (0, 1, 0), (0, 2, 1), (1, 0, 0)]


def _near_brute(rows, size):
    sets, parent = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    r, rows = random.Random(1), []
    words = [str(i) for i in range(3000)]
    for i in range(150):
        if i % 3 == 0:
            base = [r.choice(words) for _ in range(r.randint(1, 80))]
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    hub = [r.choice(words) for _ in range(100)]  # a group whose members are near the hub, but hardly each other
    for i in range(200, 240):
        k = r.randrange(0, 80)
        rows.append((i, " ".join(hub[:k] + [r.choice(words) for _ in range(6)] + hub[k + 6 :])))
    rows += [(300, " ".join(hub)), (900, None), (901, "  "), (902, "A b"), (903, "a B"), (904, "x" * 20000), (905, "x" * 20000 + " "), (906, "x" * 20001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(minhash.near_duplicates(df, size), "doc_id", "n_shingles", "component_id", "kept") == sorted(_near_brute(rows, size), key=repr)


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (3, "a b c d e"), (None, "a b c d e"), (4, "z")]
    out = as_rows(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id", "kept")
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)], key=repr)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[200 + i] == 100 for i in range(50)) and out[300] == 299


def _repeats_brute(rows, length):
    seen, out = collections.Counter(), []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings_equal_brute_force(spark):
    r, rows = random.Random(3), []
    base = ["".join(r.choice("abcd é") for _ in range(300)) for _ in range(5)]
    for i in range(50):
        parts = [r.choice(base)[r.randint(0, 80) : r.randint(150, 300)] if r.random() < 0.5 else "".join(r.choice("xyz") for _ in range(30)) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (105, "q" * 39), (None, base[0]), (8, base[1]), (8, base[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_rows(suffix_dedup.remove_repeats(df, 40), *columns) == _repeats_brute(rows, 40)


def _prose(r, n):
    return [f"the{r.randint(0, 9)}" if r.random() < 0.4 else f"w{r.randint(0, 3000)}" for _ in range(n)]


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(6)
    items = [(i, " ".join(_prose(r, r.randint(15, 60)))) for i in range(40)] + [(98, None), (99, "")]
    rows = [(i, " ".join(_prose(r, r.randint(5, 400)))) for i in range(400)] + [(None, None), (500, "")]
    want = set()
    for i in range(0, 400, 5):
        words, item = rows[i][1].split(), items[i // 5 % 40]
        leaked = item[1].upper().split() if i % 2 else item[1].split()
        if i % 10 == 0 and len(leaked) > 30:  # a paraphrase: some words changed
            for k in r.sample(range(len(leaked) - 5), len(leaked) // 8):
                leaked[k] = "other"
        at = r.randint(0, len(words))
        rows[i] = (i, " ".join(words[:at]) + "\n" + "!! ".join(leaked) + "\n" + " ".join(words[at:]))
        want.add((i, item[0]))
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()} == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(want)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def _leak_brute(item, text):
    """The rule by definition: the best stretch of the text, with the longest common subsequence as a table."""

    def common(a, b):
        row = [0] * (len(a) + 1)
        for w in b:
            before = row[:]
            for i, v in enumerate(a):
                row[i + 1] = before[i] + 1 if v == w else max(before[i + 1], row[i])
        return row[-1]

    best = None
    reach = 2 * len(item) + 36
    if sum(w in item for w in text) >= 0.6 * len(item):
        for i in range(max(1, len(text) - reach + 1)):
            part = [w for w in text[i : i + reach] if w in item]
            shared = common(item, part) if len(part) >= 0.6 * len(item) else 0
            told = shared >= 0.6 * len(item) and common(item[-5:], part) >= 0.8 * len(item[-5:])
            if shared >= 0.75 * len(item) or told:
                best = max(best or (0.0, False), (shared / len(item), told))
    return best


@pytest.mark.parametrize("rarest", [False, True])
def test_changed_items_equal_brute_force(spark, rarest):
    r = random.Random(16)
    items = [(i, _prose(r, r.randint(6, 60))) for i in range(20)]
    rows, want, qualify = [], {}, 0
    for i in range(100):
        item = items[i % 20][1]
        leaked = item[:]
        places = sorted(range(len(item) - 5), key=lambda k: (item[k][0] != "w" if rarest else 0, r.random()))
        for k in places[: round(len(item) * r.uniform(0.12, 0.35))]:
            leaked[k] = f"w{r.randint(0, 3000)}"
        words = _prose(r, r.randint(0, 100))
        at = r.randint(0, len(words))
        rows.append((i, words[:at] + leaked + words[at:]))
        qualify += _leak_brute(item, leaked) is not None
        for k, other in items:
            found = _leak_brute(other, rows[-1][1])
            if found:
                want[i, k] = found
    assert qualify >= 80
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(x.doc_id, x.item_id): (x.overlap, x.answer) for x in decontaminate.find_leaks(docs, bench).collect()} == want


def test_common_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4], [9, 1, 3, 7, 4, 2]) == 3 and decontaminate.common_subsequence([1, 1], [1]) == 1


def test_scores_prefer_held_out_text_of_the_corpus(spark):
    r = random.Random(8)
    sentence = lambda: " ".join(f"{r.choice('abcd')}{k}" for k in range(12))  # noqa: E731  each word tells its neighbours
    train = [(i, " ".join(sentence() for _ in range(20))) for i in range(200)]
    held = " ".join(sentence() for _ in range(30))
    words = held.split()
    shuffled = " ".join(r.sample(words, len(words)))
    rows = [*train, (1000, held), (1001, shuffled), (1002, None), (None, "a1")]
    out = {x.doc_id: x for x in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000].n_tokens == 360 and out[1000].per_token > out[1001].per_token + 0.2
    assert out[1002].n_tokens == 0 and out[1002].log_likelihood == 0 and out[1002].per_token is None and out[None].n_tokens == 1


@pytest.mark.parametrize("common", [lm_score.COMMON, 10])  # words looked up, words joined
def test_scores_tell_rare_words_of_one_class_apart(spark, monkeypatch, common):
    monkeypatch.setattr(lm_score, "COMMON", common)
    r = random.Random(9)
    kind = lambda w: int(word_hashes([w])[0][0]) % lm_score.BUCKETS % lm_score.SHARED
    one = [w for w in (f"q{i}" for i in range(400)) if kind(w) == 5]
    seen, other, once = one[:3]
    text = lambda w: f"f1 f2 {w} f3 f4"
    train = [(i, " ".join(f"f{r.randrange(150)}" for _ in range(150))) for i in range(300)]
    rows = [*train, (1000, text(seen)), (1001, text(other)), (1002, text(once)), (1003, f"{seen} " * 29), (1004, other), (1005, "?! ... é-1")]
    out = {x.doc_id: x for x in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    score = lambda i: out[i].log_likelihood
    assert score(1000) - score(1001) == pytest.approx(np.log(30 / 2)) and score(1001) - score(1002) == pytest.approx(np.log(2))
    assert out[1003].n_tokens == 29 and out[1005].n_tokens == 8 and score(1005) < 0


@pytest.mark.parametrize("held", [1 << 18, 50])  # all at once, a few tokens at a time
def test_scores_equal_a_plain_sum_over_tokens(spark, monkeypatch, held):
    monkeypatch.setattr(lm_score, "SLICE", held)
    r = random.Random(11)
    rows = [(i, " ".join(f"t{int(r.expovariate(0.05))}" for _ in range(r.randrange(40)))) for i in range(120)] + [(500, None), (501, "new! one")]
    words = store_words(id_and_text(spark.createDataFrame(rows, "doc_id long, text string")), "words", symbols=True)
    train = words.where("doc_id < 500")
    counts, table, totals, net = lm_score.fit(train)
    n = {x.word: x.n for x in counts.collect()}
    vectors, out, bias = (p.astype(float) for p in (net.vectors, net.out, net.bias))
    got = {x.doc_id: x.log_likelihood for x in lm_score.score_words(words, counts, table, totals, net).collect()}
    for doc_id, text in rows:
        ids = word_hashes([text or ""], symbols=True)[0].tolist()
        classes = [int(table[w % lm_score.BUCKETS]) for w in ids]
        total = 0.0
        for i, c in enumerate(classes):
            hidden = np.zeros(lm_score.HIDDEN)
            for k, at in enumerate((i - 2, i - 1, i + 1, i + 2)):
                hidden += vectors[k][classes[at] if 0 <= at < len(classes) else lm_score.NONE]
            logits = np.tanh(hidden) @ out + bias
            total += logits[c] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
            total += np.log(max(1, n.get(ids[i], 0)) / (totals[c] + 1))
        assert got[doc_id] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = line_dedup.drop_lines(quality.keep_good(docs)).select("doc_id", "text").collect()
    best = {d for d, _, _, k in _near_brute([(r.doc_id, r.text) for r in kept], 5) if k}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in kept if r.doc_id in best}
    bench = [" ".join(re.findall(r"\w+", x.text.lower())) for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = {d: " ".join(re.findall(r"\w+", t.lower())) for d, t in texts.items()}
    clean = {d for d, t in plain.items() if not any(b in t for b in bench)}
    assert set(rows) <= clean and len(rows) >= 0.99 * len(clean)
    assert all(rows[d].decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest() for d in rows)


def test_leak_search_holds_bounded_memory():
    rng = np.random.default_rng(5)
    docs = rng.integers(0, 1 << 32, (2000, 600), dtype=np.uint32)
    packed = pa.RecordBatch.from_arrays(
        [pa.array(range(len(docs)), pa.int64()), pa.array([d.astype("<u4").tobytes() for d in docs], pa.binary())], ["doc_id", "words"]
    )
    items = [(i, docs[10 * i, 100:160].tolist()) for i in range(100)]
    basis = rng.standard_normal((decontaminate.FEATURES + 1, decontaminate.RANK)).astype(np.float32)
    basis[-1] = 0
    idf, counts = np.ones(decontaminate.FEATURES + 1, np.float32), np.zeros(decontaminate.COUNTED, np.int64)
    search = decontaminate._search(basis, idf, counts, items)
    tracemalloc.start()
    try:
        found = {(d, k) for b in search(iter([packed])) for d, k in zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist())}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == {(10 * i, i) for i in range(100)}
    assert peak < 60 << 20, peak
