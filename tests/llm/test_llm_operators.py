"""Operators of the training-data subpackage against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mnemora.llm import (
    bpe, chat_format, common, components, decontaminate, embedding_dedup, licenses, ngram_join, quality, substring_dedup, token_files,
    toxicity,
)
from mnemora.llm import words as W
from mnemora.llm.fm_index import FMIndex

EXTRA = "rid long, score double, key string, label int, kept string, n_words string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


def texts():
    rng = random.Random(7)
    base, passage = sentence(rng, 150), sentence(rng, 70)
    found = [None, "", "  \n\t ", "one", "one two", "One  two\n", "ünï çødé 漢字 ok", sentence(rng, 9000), base, base, base.upper()]
    words = base.split()
    for i in range(12):  # near copies with few and with many changed words
        copy = list(words)
        for j in range(i):
            copy[(j * 23 + i) % 150] = f"x{i}y{j}"
        found.append(" ".join(copy))
    found += [sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 40) for _ in range(5)]
    found += [sentence(rng, rng.randint(1, 12)) for _ in range(10)] + ["tick " * 400]
    return found


def documents(spark, rows=None):
    """doc_id and text with extra columns of clashing names; one id is null, one row is there twice."""
    rows = list(enumerate(texts())) if rows is None else rows
    rows = [(i * 3 + 1, t, None, 0.5, "k", 1, "x", "y") for i, t in rows]
    if rows:
        rows += [(None, sentence(random.Random(1), 60), 1, None, None, 0, None, None), rows[-1]]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").coalesce(1)


def pairs(rows):
    return sorted(((r["doc_id"], *r) for r in rows), key=repr)


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepared(spark)


def test_words_match_patterns():
    column = pa.array(texts())
    for classes, pattern, lower in ((W.FIELDS, r"[^\x20\x09-\x0D]+", False), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = W.words(column, classes, lower)
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for i, text in enumerate(column.to_pylist()):
            want = re.findall(pattern, (text or "").translate(fold) if lower else text or "")
            at = range(w.first[i], w.first[i + 1])
            got = [bytes(w.data[w.start[j] : w.end[j]]).decode() for j in at]
            assert (got if not lower else [g.translate(fold) for g in got]) == want
            assert [int(w.hash[j]) for j in at] == [W.hash_of(x, lower) for x in want]


def test_a_word_longer_than_a_piece():
    text = "a" * 200_000 + " b"
    w = W.words(pa.array([text, "b"]), W.FIELDS)
    assert w.count.tolist() == [2, 1] and w.hash[1] == w.hash[2]


def test_chat_round_trip(spark):
    hard = ["", None, "\\", "\\n", "<|", "<|im_start", "<|im_end|>", "a<|im_end|>\n<|im_start|>user\nb", "\\<|x\\\\<", "x\n", "<|im_start:e|>z"]
    rows = [(c, t, role, text, "extra") for c, role in ((1, "user"), (2, "assistant"), (None, "a\n<|b\\"), (3, None))
            for t, text in [*enumerate(hard), (0, "tie"), (0, "tie"), (None, "first")]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.formatted_conversations(table)
    assert out.where(~F.equal_null(chat_format.parsed(F.col("formatted")), F.col("turns"))).count() == 0
    assert out.where("n_escaped > 0 AND n_escaped < size(turns)").count() > 0
    got = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        spoken = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        masked = "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert chat_format.formatted_conversations(table.limit(0)).count() == 0


def hit_words(text, items):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    words, hit, found = cut(text), set(), set()
    for item, other in items:
        other = cut(other)
        n = min(10, len(other))
        windows = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), found


def test_decontamination(spark):
    rng = random.Random(3)
    item = sentence(rng, 40)
    words = item.split()
    items = [(1, item), (2, " ".join(words[5:18]) + " tail"), (3, "short item here"), (4, None), (5, ""), (6, "one"),
             (7, " ".join(words[:10])), (None, item), (1, "other text of the same item with more than ten words in it")]
    extra = [sentence(rng, 5) + " " + " ".join(words[a:b]) + " " + sentence(rng, 5) for a, b in ((0, 9), (0, 10), (3, 30), (12, 25))]
    extra += ["Short, ITEM here!", "x one y", " ".join(words[:9])]
    docs = documents(spark, list(enumerate(texts() + extra)))
    known = [(i, t) for i, t in items if i is not None]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for r in docs.collect():
        n, hit, found = hit_words(r["text"], known)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((r["doc_id"], n, hit, len(found), digest, hit > 0))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
    assert decontaminate.decontaminated(docs, none).columns == docs.columns


def labelled(spark, make):
    rng = random.Random(5)
    rows = [(i, make(i % 4 == 0, rng)) for i in range(240)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i * 3 + 1, 0 if i % 4 == 0 else 1, 1 if i % 4 == 0 else 0) for i, _ in rows] + [(None, 1, 0), (9, None, None)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(spark, lambda bad, rng: sentence(rng, 40).replace(" ", "$$$ ") if bad else sentence(rng, 40))
    rows = quality.quality(docs, labels)
    assert rows.columns == ["doc_id", "text", *[c for c in docs.columns[2:] if c != "score"], "score"] and rows.count() == docs.count()
    held = rows.where(quality.held_out("doc_id", 5, 0)).join(labels.drop("text"), "doc_id").collect()
    assert len(held) > 20 and all((r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < 200
    none = quality.quality(documents(spark), labels.limit(0)).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    def make(bad, rng):
        words = sentence(rng, 30).split()
        if bad:
            words[rng.randint(3, 20)] = rng.choice(["zonk", "Zonk", "bliffer" + sentence(rng, 1)])
        return " ".join(words) + "."

    docs, labels = labelled(spark, make)
    rows = toxicity.toxicity(docs, labels)
    assert rows.count() == docs.count() and rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = rows.where(quality.held_out("doc_id", 3, 1)).join(labels, "doc_id").collect()
    assert len(held) > 50 and np.mean([(r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in held]) > 0.97
    assert toxicity.toxicity(documents(spark), labels.limit(0)).where("score >= 0.7").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_clause_states():
    forms = np.array([W.hash_of("zonk")], np.uint64)
    x = toxicity.Grammar(forms, np.array([5.0])).features(pa.array(
        ["a zonk b", "you zonk", "not a zonk", "not; a zonk", "he said zonk", "kill you", "", None, "not one of a zonk"]))
    assert [np.flatnonzero(r).tolist() for r in x] == [[0], [1], [2], [0], [5], [8], [], [], [0]]


def test_contractions_forms_of_harm_and_runs_of_signs():
    grammar = toxicity.Grammar(np.array([W.hash_of("zonk")], np.uint64), np.array([5.0]))

    def states(*texts):
        return [np.flatnonzero(r).tolist() for r in grammar.features(pa.array(texts, pa.string()))]

    assert all(s == [2] for s in states(*[f"a {w} a zonk" for w in toxicity.NEGATION]))
    short = "isn't aren't don't doesn't won't can't DON'T isn’t Won’t".split()
    assert all(s == [2] for s in states(*[f"a {w} a zonk" for w in short])) and states("you aren't an zonk") == [[3]]
    assert states("an' t zonk", "n 't zonk", "a 't zonk", "cat't zonk", "t zonk", "’t zonk") == [[0]] * 6
    assert all(s == [8] for s in states(*[f"{w} you" for w in toxicity.HARM]))
    assert all(s == [4] for s in states(*[f"{w} zonk" for w in toxicity.REPORTED]))
    assert all(s == [1] for s in states(*[f"{w} zonk" for w in toxicity.TARGET]))
    assert states('not". a zonk', "said (not). a zonk", 'said ") a zonk') == [[0], [0], [4]]


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    docs = documents(spark)
    folder = common.fresh_folder(spark, "tokens")
    files = token_files.write_tokens(docs, bpe.vocabulary_path(), folder)
    got = token_files.read_tokens(files, folder).orderBy("start").collect()
    at, want = 0, []
    for doc_id, text in sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    ids, mask = token_files.SequenceReader(folder, files.first()["part"]).sequence(0)
    assert len(ids) == len(mask) == token_files.LENGTH
    empty = token_files.write_tokens(docs.limit(0), bpe.vocabulary_path(), common.fresh_folder(spark, "tokens"))
    assert token_files.read_tokens(empty, folder).count() == 0


def linked(sets, same):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if same(sets[i], sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def test_jaccard_join(spark):
    docs = documents(spark)
    rows = docs.collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(fold))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = linked(sets, lambda a, b: a and b and 100 * len(a & b) >= 90 * len(a | b))
    least = {}
    for r, t in zip(rows, root):
        if r["doc_id"] is not None:
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], len(s), least.get(t) if s else r["doc_id"]) for r, s, t in zip(rows, sets, root)), key=repr)
    assert len(set(root)) < len(rows) - 5
    got = ngram_join.joined(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert ngram_join.joined(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = ngram_join.joined(common.saved(kept, "kept")).where("n_shingles > 0 AND component_id IS NOT NULL")
    assert left.groupBy("component_id").count().where("count > 1").count() == 0


def test_jaccard_join_of_five_words(spark):
    """Five words and 0.8 against all pairs; 2% of words changed links at 5/0.8 and not at 3/0.9."""
    rng = np.random.default_rng(8)
    texts = []
    for n in (3, 5, 8, 9, 12, 40, 120, 500, 500, 1500):
        base = [f"w{v}" for v in rng.integers(0, 5000, n)]
        for changed in (0, 0, 0.01, 0.02, 0.02, 0.03, 0.05):
            w = list(base)
            for i in rng.choice(n, int(np.ceil(changed * n)), False) if n > 9 or changed != 0.01 else []:
                w[i] = f"x{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
            texts.append(" ".join(w[: max(1, n - n // 9)]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {k: [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in map(str.split, texts)] for k in (3, 5)}
    want = linked(sets[5], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert want != linked(sets[3], lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(docs, 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(2)
    for size in (9, 40, 200, 900, 3000):
        base = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        sets = [base] + [np.unique(np.concatenate([base[n:], rng.integers(1, 1 << 63, n, dtype=np.uint64)])) for n in range(1, max(2, size // 15), max(1, size // 60))]
        ok = ngram_join.may_be_similar(np.array([len(s) for s in sets]), [ngram_join.parity(s, len(s)).tobytes() for s in sets])
        for i in range(len(sets)):
            for j in range(len(sets)):
                if i != j and ngram_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    assert ok[i, j]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(1)
    pool = "abthninreon'<|>éèßÄİΣñ日本0123 \t\n\x0b\x1c\x85\xa0́̊½²٣.,!?-_😀‍힣"
    cases = ["", "<|endoftext|>", "x<|endoftext|>y z", "<|ENDOFTEXT|>", "H̱ Å", "a" * 5000, "in" * 3000 + ".", "ha" * 2500]
    cases += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    cases += ["".join(rng.choice("theinaorsd") for _ in range(4000)) for _ in range(4)]
    vocabulary, chunks = bpe.loaded(bpe.vocabulary_path())
    want = [e.ids for e in tokenizer.encode_batch(cases, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.split(*chunks.encoded(pa.array(cases)))]
    assert got == want
    for ids in want[:400]:
        machine = bpe.Decoder(vocabulary)
        fed = "".join(machine.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + machine.end()
        assert fed == tokenizer.decode(ids, skip_special_tokens=False)
    assert chunks.encoded(pa.array([None, ""]))[1].tolist() == [0, 0, 0]


def test_transducer_settles_early_and_keeps_little():
    vocabulary, _ = bpe.loaded(bpe.vocabulary_path())
    machine = bpe.Transducer(vocabulary)
    out, most = [], 0
    for _ in range(40):
        out += machine.feed(b"thenationing" * 100)
        most = max(most, len(machine.pending))
    assert out and most < vocabulary.lookahead + 2 * bpe.BLOCK
    assert out + machine.end(b"s") == bpe.encoder(vocabulary)(["thenationing" * 4000 + "s"])[0]


def test_bpe_on_rows(spark):
    docs = documents(spark)
    path = bpe.vocabulary_path()
    ids = bpe.encoded(docs, path)
    texts_back = {r["doc_id"]: r["text"] for r in bpe.decoded(ids, path, plain=True).collect()}
    assert texts_back[5 * 3 + 1] == "one two " and bpe.digests(docs, path).count() == docs.count()
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 9))
    x = [c + rng.normal(size=9) * s for c in centres for s in (0.0, 0.05, 0.1, 0.3, 0.5)] + list(rng.normal(size=(40, 9)))
    rows = [(i, v.astype(np.float32).tolist(), "n") for i, v in enumerate(x)]
    rows += [(100, rows[0][1], "n"), (101, None, "n"), (102, [0.0] * 9, "n"), (103, [float("nan")] * 9, "n"), (104, [None] + [1.0] * 8, "n"),
             (105, [float("inf")] * 9, "n"), (None, rows[0][1], "n"), (106, [2 * v for v in rows[3][1]], "n")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    names = sorted(good)
    link = lambda a, b: a @ b >= 0.9
    root = dict(zip(names, linked([good[n] for n in names], link)))
    want = []
    for i, _, _ in rows:
        n = sum(link(good[i], good[j]) for j in names if j != i) if i in good else 0
        least = names[root[i]] if i in good else i
        want.append((i, n, least, i is not None and least == i))
    got = [tuple(r) for r in embedding_dedup.near_vectors(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(table.where("vec_id = 102")).first()["n_links"] == 0


def test_embeddings_without_clusters(spark):
    """Random vectors with partners at cosine 0.90 to 0.95: none is missed."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20000, 64))
    for i, cosine in enumerate(np.linspace(0.901, 0.95, 400)):
        one = x[i] / np.linalg.norm(x[i])
        other = x[-1 - i] - (x[-1 - i] @ one) * one
        x[-1 - i] = cosine * one + np.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(frame).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[i : i + 2000] @ x.T >= 0.9).sum(1) - 1 for i in range(0, len(x), 2000)])
    assert want.sum() >= 800 and [got[i] for i in range(len(x))] == want.tolist()


def test_numbers_do_not_follow_the_cores(spark, tmp_path):
    """Splits of a scan, and with them the numbers of rows, stay when cores come or go between two actions."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    for i in range(3):
        rows = pa.table({"doc_id": np.arange(3000) + i * 3000, "text": [f"{i} {j} " * 20 for j in range(3000)]})
        pq.write_table(rows, tmp_path / f"{i}.parquet", row_group_size=100)
    rows = common.numbered(session.read.parquet(str(tmp_path)).select("doc_id", "text"))
    got = []
    for cores in (2, 16):
        session.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        got.append(sorted(map(tuple, rows.select("doc_id", "rid").collect())))
    assert got[0] == got[1]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (50, 40)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}
    assert components.components(links.limit(0)).count() == 0


def test_fm_index_finds_every_window():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50, 90).astype(np.uint64)
    sequences = [base, base[10:75], np.concatenate([rng.integers(0, 50, 20).astype(np.uint64), base[5:65]]), base[:50], rng.integers(0, 3, 120).astype(np.uint64)]
    index = FMIndex(sequences, 50)
    value = np.array([5, 3, 9, 7, 1])
    least = index.least(value)
    got = {(int(i), int(p)): int(least[b]) for lanes, place, block in index.matches() for i, p, b in zip(lanes, place, block)}
    for i, s in enumerate(sequences):
        for p in range(len(s) - 49):
            w = s[p : p + 50].tobytes()
            holders = [value[j] for j, o in enumerate(sequences) if any(o[q : q + 50].tobytes() == w for q in range(len(o) - 49))]
            assert got.pop((i, p)) == min(holders)
    assert not got


def test_substring_dedup(spark):
    rng = random.Random(11)
    passage = sentence(rng, 120)
    extra = [sentence(rng, k) + " " + " ".join(passage.split()[a:b]) + " " + sentence(rng, 30)
             for k, a, b in ((3, 0, 120), (40, 0, 49), (40, 0, 50), (0, 30, 95), (7, 60, 120), (100, 10, 119))]
    docs = documents(spark, list(enumerate(texts() + extra)))
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    first = {}
    for doc, w in rows:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if doc is None else doc)
    want = []
    for doc, w in rows:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (1 << 62 if doc is None else doc):
                gone |= set(range(i, i + 50))
        want.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sum(r[2] for r in want) > 300 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0
    short = substring_dedup.shortened(docs)
    assert short.columns == docs.columns and short.count() == docs.count()


def test_licences(spark):
    wrapped = {name: " ".join(w + ("\n" if i % 9 == 8 else "") for i, w in enumerate(s.split())).replace("\n ", "\n").strip()
               for name, s in licenses.SENTENCES.items()}
    mit = ". \n".join(wrapped[n].capitalize() for n in ("mit-grant", "mit-notice", "mit-warranty")) + "."
    cases = [(mit, "MIT"), (mit.split(". \n")[0] + ".", "MIT-like"), ("Intro.\nReleased under the MIT License.\nall right", "MIT"),
             ("LICENSED UNDER   CC-BY-NC 4.0!", "CC-BY-NC-4.0"), ("x. All rights reserved.\n\nDistributed under the GPLv3", "GPL-3.0,all-rights-reserved"),
             (". ".join(licenses.SENTENCES[n] for n in ("bsd-grant", "bsd-source", "rights", "bsd-binary", "bsd-names")), "BSD-3-Clause,all-rights-reserved"),
             (". ".join(licenses.SENTENCES[n] for n in ("bsd-source", "bsd-grant")), "BSD-like"), (None, ""), ("", ""), ("not licensed under the MIT license", ""),
             ("word " * 20000 + ". All rights reserved.", "all-rights-reserved")]
    rows = [(None if i == 2 else i, t, "k", "s") for i, (t, _) in enumerate(cases)] + [(3, cases[3][0], "k", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, licences string, sentence string").coalesce(1)
    got = [r["licences"] for r in licenses.licences(table).orderBy("rid").collect()]
    assert got == [want for _, want in cases] + [cases[3][1]]
    assert licenses.licences(table.limit(0)).count() == 0


def test_every_known_sentence_has_a_mark():
    assert all(re.search(licenses.MARKS, s) or re.search(licenses.MARKS, f"x {s}") for s in licenses.catalogue())
    assert {i for family in licenses.RULES for _, rule in family for i in rule} == set(licenses.catalogue().values())


def test_multi_sequence_traversal():
    """The traversal meets every held cell within reach, each once, and skips others."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 16)) + 4 * rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.MultiIndex(*(embedding_dedup.codebook(h, 24) for h in embedding_dedup.halves(x)))
    cells = index.cells(x)
    held, radii = embedding_dedup.held_cells(cells, index.radii(x, cells))
    found, counts = index.visits(x, held, radii)
    a, b = (np.sqrt(d) for d in index.distances(x))
    gap = np.maximum(a[:, held // 24] - radii[0], 0) ** 2 + np.maximum(b[:, held % 24] - radii[1], 0) ** 2
    want = [held[row <= embedding_dedup.REACH**2].tolist() for row in gap]
    got = [sorted(part.tolist()) for part in np.split(found, np.cumsum(counts)[:-1])]
    assert got == want and counts.sum() < 0.5 * gap.size
    seen = sum(len(row) for row, _ in index.traversal(x, held, radii))
    assert counts.sum() <= seen < gap.size


def test_vectors_of_another_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, []), (6, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_ranges_of_a_bucket():
    rng = random.Random(3)
    rows = [{
        "bucket": 1,
        "places": [{"rid": rng.randrange(50), "doc": rng.randrange(50), "pos": rng.randrange(300)} for _ in range(rng.randint(1, 4))],
        "runs": [{"first": rng.randrange(30), "n": rng.randint(1, 6), "source": rng.randrange(50)} for _ in range(rng.randint(1, 3))],
    } for _ in range(400)]
    for part in (rows, rows[7:90], rows[:1], [r | {"places": [p | {"doc": 0} for p in r["places"]]} for r in rows[:9]]):
        covered = {}
        for r in part:
            for p in r["places"]:
                for u in r["runs"]:
                    if u["source"] < p["doc"]:
                        begin = max(p["pos"] - substring_dedup.SIDE, 0) + u["first"]
                        covered.setdefault(p["rid"], set()).update(range(begin, begin + u["n"] - 1 + substring_dedup.WINDOW))
        table = pa.Table.from_pylist(rows + part).slice(len(rows))
        got = substring_dedup._ranges(table).to_pylist()
        assert {x["rid"]: {j for a in x["ranges"] for j in range(a["begin"], a["end"])} for x in got} == covered
        for x in got:
            assert all(a["end"] < b["begin"] for a, b in zip(x["ranges"], x["ranges"][1:]))


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
APACHE = """Copyright 2019 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES_CLAUSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GNU = """This program is free software{}
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.
"""


def test_licence_texts(spark):
    cases = [
        (MIT, "MIT"), (MIT.replace("\nSoftware is", " Software is"), "MIT"), (MIT[: MIT.index("THE SOFTWARE")], "MIT-like"), (APACHE, "Apache-2.0"),
        (BSD, "BSD-2-Clause"), (BSD + NAMES_CLAUSE, "BSD-3-Clause"), (ISC, "ISC"),
        (GNU.format(": you can redistribute it and/or modify", "", ",", 3), "GPL-3.0"),
        (GNU.format("; you can redistribute it and/or modify", "", ";", 2), "GPL-2.0"),
        (GNU.format(": you can redistribute it and/or modify", "Lesser ", ",", 3), "LGPL-3.0"),
        (GNU.format(": you can redistribute it and/or modify", "Affero ", ",", 3), "AGPL-3.0"),
        *[(f"# SPDX-License-Identifier: {name}\nimport os\n", name.removesuffix("-only").removesuffix("-or-later")) for name in (
            "MIT", "Apache-2.0", "GPL-3.0-only", "GPL-2.0-or-later", "LGPL-3.0-or-later", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0")],
        ("Nothing to see\nHere is prose. The Software works", ""),
    ]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["licences"] for r in licenses.licences(frame).collect()}
    assert [got[i] for i in range(len(cases))] == [name for _, name in cases]


def test_blocks_of_cells():
    got = embedding_dedup.dealt(np.array([2, 5, 6, 9, 11]), np.array([3, 4, 25, 4, 7]), 10)
    assert [(c.tolist(), part, parts) for c, part, parts in got] == [
        ([2, 5], 0, 1), ([6], 0, 3), ([6], 1, 3), ([6], 2, 3), ([9], 0, 1), ([11], 0, 1)]


def test_vectors_in_blocks_without_shuffled_visits(spark, tmp_path, monkeypatch):
    """Links within and between blocks of cells, a cell larger than a block, copies; what is written grows with the rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=(3, 16)).repeat(300, 0) + rng.normal(size=(900, 16)) * 0.12])
    x = np.concatenate([x, x[-40:], x[:9]]).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x))[::-1].copy(), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    label, ids = np.arange(len(x))[::-1].copy(), np.arange(len(x))[::-1]
    for _ in range(50):
        label = np.where(link, label, len(x)).min(1)
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(1) - 1, label)}
    for size in (8 * 16 * 128, 8 * 16 * 100_000):
        monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", size)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame).collect()}
        assert got == want
    seen = []
    monkeypatch.setattr(embedding_dedup, "saved", lambda rows, name: (seen.append((name, len(rows.columns))), common.saved(rows, name))[1])
    embedding_dedup.near_vectors(frame)
    assert [name for name, _ in seen] == ["cells"]  # one row a vector: no table of visits
