"""Cross-tokenizer alignment, ranked lexical search and chat formatting against plain computations."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcloom.llm import bpe, chat_format, lexical_search, token_alignment
from srcloom.llm.queries import BYTE_BPE, PIECE_BPE

SCHEMA = "doc_id long, text string, item_id string, pieces string, block long, items string, rank int"


def prose(n, seed, words=300):
    r = random.Random(seed)
    return " ".join(r.choice(("ka", "Lo", "mi")) + str(r.randrange(words)) for _ in range(n))


LONG = prose(4000, 1)
TEXTS = [
    None, "", " \n\t ", "x", " x", "one two  three\n\nfour ", LONG, LONG, LONG + " tail", prose(120, 2), prose(120, 2),
    "日本語 é\xa0 x\x1cy", "<|endoftext|> a<|endoftext|>b <s>x</s>", "aaa " * 300, "It's  we'll\n\n  done 123 45.6!?",
    "has ▁ mark", "▁", "z" * 20000, "ﬁ Ａ é", "﻿bom", "tail space ", "q" + " " * 50 + "r",
]
ROWS = [(i, t, "clash", None, 1, "x", 2) for i, t in enumerate(TEXTS)] + [
    (3, "x", None, None, None, None, None), (None, LONG, None, None, None, None, None), (None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- alignment -------------------------------------------------------------------------------


def plain_alignment(table):
    import sentencepiece
    from tokenizers import Tokenizer

    from srcloom.llm.token_counts import byte_letters

    a = Tokenizer.from_file(bpe.tokenizer_path(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path(PIECE_BPE))
    letters = byte_letters()
    found, counts = [], collections.Counter()
    for doc_id, text, *_ in table:
        whole = (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        bb = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib
        ]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        ea, eb = np.cumsum(list(map(len, ba))).tolist(), np.cumsum(list(map(len, bb))).tolist()
        links, groups, i, j = [], [[[], []]], 0, 0
        while i < len(ia):
            links.append((ia[i], ib[j]))
            up_a, up_b = ea[i] <= eb[j], eb[j] <= ea[i]
            if up_a:
                groups[-1][0].append(ia[i])
                i += 1
            if up_b:
                groups[-1][1].append(ib[j])
                j += 1
            if up_a and up_b:
                groups.append([[], []])
        counts.update(links)
        found.append((doc_id, ia, ib, groups[:-1], links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, ia, ib, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc_id, len(ia), len(ib), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def test_alignment(spark, docs, monkeypatch):
    paths = bpe.tokenizer_path(BYTE_BPE), bpe.tokenizer_path(PIECE_BPE)
    wanted = plain_alignment(ROWS)
    assert rows(token_alignment.align(docs, *paths)) == wanted
    # Blocks of a document or two: the counts are still those of the whole corpus.
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 200)
    assert rows(token_alignment.align(docs, *paths)) == wanted
    assert token_alignment.align(docs.limit(0), *paths).count() == 0


def test_alignment_parts_equal_whole_texts():
    tool = token_alignment.aligner(bpe.tokenizer_path(BYTE_BPE), bpe.tokenizer_path(PIECE_BPE))
    r = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "a", "B1", "é", "'s", "'", ".", "日", "ñó", "word", "\xa0", "<s>", "0", "🙂", "▁", "-"]
    for _ in range(1500):
        text = "".join(r.choices(signs, k=r.randrange(1, 12)))
        parts = tool.split(text)
        assert "".join(parts) == " " + text
        assert [i for p in parts for i in tool.ids_a(p)] == tool.plain_a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in tool.b.encode(p[1:])] == tool.b.encode(text), text


def test_pointer_jumping_labels_chains():
    r = np.random.default_rng(1)
    for _ in range(200):
        size = int(r.integers(1, 60))
        a, b = (np.append(np.flatnonzero(r.random(size - 1) < p) + 1, size) for p in r.random(2))
        group_a, group_b, rounds = token_alignment.components(a, b)
        cuts = np.intersect1d(a, b)
        assert (group_a == np.searchsorted(cuts, a)).all() and (group_b == np.searchsorted(cuts, b)).all()
        assert rounds <= 2 + math.ceil(math.log2(len(a) + len(b)))
    # One chain over all tokens.
    _, _, rounds = token_alignment.components(np.arange(2, 4001, 2), np.append(np.arange(1, 4000, 2), 4000))
    assert rounds <= 14


# ---- search ----------------------------------------------------------------------------------


def plain_search(docs, items, k):
    bags = collections.defaultdict(set)
    for item, text in items:
        bags[item].add(text or "")
    texts = [(i, lexical_search.terms(t or "")) for i, t in docs]
    texts = [(i, t, collections.Counter(t)) for i, t in texts if t]
    n_docs, length = len(texts), sum(len(t) for _, t, _ in texts)
    df = collections.Counter(w for _, _, c in texts for w in c)
    out = []
    for item, whole in bags.items():
        bag = collections.Counter(w for t in whole for w in lexical_search.terms(t))
        scored = []
        for i, t, often in texts:
            m = 75 + (25 * len(t) * n_docs) // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * often[w]) // (1000 * often[w] + 12 * m))
                for w, times in bag.items() if often[w]
            )
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [
    (1, "ka1 ka1 Lo2 mi3 LO2"), (2, None), (2, ""), (3, prose(40, 9)), (3, prose(10, 8)), (3, prose(10, 8)), (4, "absent words only"),
    (5, "x"), (None, "aaa it s 123"), (6, "日本語 é"), (7, LONG), (8, "zzz " + "z" * 20000),
]


@pytest.mark.parametrize("k, item_rows, most", [(3, 200_000, 2048), (20, 100, 8)])
def test_search(spark, docs, monkeypatch, k, item_rows, most):
    monkeypatch.setattr(lexical_search, "ITEM_ROWS", item_rows)
    monkeypatch.setattr(lexical_search, "MOST_DOCS", most)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, doc_id int, term int")
    more = [(100 + i, prose(5 + i % 90, i), None, None, None, None, None) for i in range(400)]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    plain = plain_search([r[:2] for r in ROWS + more], ITEMS, k)
    assert rows(lexical_search.search(table, items, k)) == plain
    assert lexical_search.search(table, items.limit(0), k).count() == 0
    assert lexical_search.search(table.limit(0), items, k).count() == 0


def test_bounds_are_never_too_low(spark):
    """Every bound is at least the exact score, and most documents are excluded without being read."""
    texts = [prose(20 + i % 200, i, 5000) for i in range(1500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = lexical_search.build_index(table).collect()
    asked = [texts[5][:200], "ka7 ka7 Lo8", texts[900]]
    items = lexical_search.Items([r for i, t in enumerate(asked) for r in (
        {"item_id": i, "term": w, "times": c} for w, c in collections.Counter(lexical_search.terms(t)).items())])
    items.weigh(len(texts), sum(len(lexical_search.terms(t)) for t in texts), lexical_search.document_frequencies(table, items))
    uppers, scores = [], []
    for row in index:
        for start, upper in lexical_search.bounds(items, row.asDict()):
            for d, doc in enumerate(row["doc_ids"]):
                exact = items.scores(texts[doc], list(range(len(asked))))
                assert (upper[:, d] >= exact).all() and start == 0
                uppers.append(upper[:, d])
                scores.append(exact)
    assert sum(len(r["doc_ids"]) for r in index) == len(texts)
    uppers, scores = np.array(uppers), np.array(scores)
    kth = np.sort(scores, axis=0)[-20]
    assert ((uppers >= kth).sum(axis=0) < [150, 75, 225]).all()


def test_frequencies_survive_equal_hashes(spark, monkeypatch):
    """With a hash that sees lengths only, the bytes still decide."""
    real = lexical_search.Terms.__init__

    def weak(self, texts):
        real(self, texts)
        self.hashes = (self.ends - self.starts).astype(np.uint64)

    monkeypatch.setattr(lexical_search.Terms, "__init__", weak)
    items = lexical_search.Items([{"item_id": 1, "term": w, "times": 1} for w in ("ab", "abc")])
    table = [(1, "ab cd ab"), (2, "cd ab"), (3, "xyz cd abc"), (4, "AB xyz")]
    found = {}
    got = {0: 0, 1: 0}
    # The worker would import the module anew, so the function under test runs here.
    frame = type("F", (), {"mapInArrow": lambda self, run, schema: found.update(run=run) or self, "groupBy": lambda self, *a: self,
                           "agg": lambda self, *a: self, "collect": lambda self: []})()
    monkeypatch.setattr(lexical_search.common, "id_and_text", lambda docs: frame)
    lexical_search.document_frequencies(frame, items)
    import pyarrow as pa

    for out in found["run"](iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in table])])):
        for term, df in zip(out.column("term").to_pylist(), out.column("df").to_pylist()):
            got[term] += df
    assert got == {0: 3, 1: 1}


# ---- chat ------------------------------------------------------------------------------------

SIGNS = ["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "</SYS>>", "</s>", "<s>", "[INST]", "[/INST]", " ", "\n", "ROLE]", "[TEXT]",
         "[/ROLE]", "[ROLE]", "x", "é", "<<SYS>>"]
ODD_TEXTS = st.lists(st.sampled_from(SIGNS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(ODD_TEXTS, ODD_TEXTS)
def test_turns_read_back(role, text):
    for name in (role, "user", "assistant", "system"):
        piece, escaped = chat_format.round_trip(name, text)
        following, _ = chat_format.round_trip("assistant", role)
        assert [t[:2] for t in chat_format.read_turns(piece + following + piece)] == [(name, text), ("assistant", role), (name, text)]
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert bool(escaped) == (chat_format.escape(text) != text or (name not in chat_format.FRAMES and chat_format.escape(name) != name))


def test_parser_refuses_broken_texts():
    for broken in ("<s>[INST] a", "<s>[INST] a</s>", "x", " a [INST] b</s>", "[ROLE]a[/ROLE]\n", "<<SYS>>\n\n"):
        with pytest.raises(chat_format.Conflict):
            list(chat_format.read_turns(broken))


CHATS = [
    (1, 2, "assistant", "two </s> \\ <\\/s>"), (1, 0, "system", "be [INST] kind"), (1, 1, "user", None), (2, None, None, "late"), (2, 0, "user", ""),
    (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 3, "tool [TEXT]", "out"), (None, 0, "assistant", "é🙂"), (None, 1, "assistant", ""),
    (3, 0, "assistant", "long " * 300_000), (3, 1, "assistant", "<s>" * 1000),
]


def plain_chat(turns):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = role or "", text or ""
        r, t = ((x if role in chat_format.FRAMES else chat_format.escape(x)) if i == 0 else chat_format.escape(x) for i, x in enumerate((role, text)))
        groups[conv].append(((turn is not None, turn or 0, chat_format.render(r, t).encode()), role, text))
    out = []
    for conv, members in groups.items():
        members.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in members)
        loss = "".join(t for _, r, t in members if r == "assistant")
        pieces = sum(len(key[2].decode()) for key, _, _ in members)
        hexes = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        out.append((conv, len(members), hexes[0], len(loss), hexes[1], pieces, sum(chat_format.escape(t) != t for _, _, t in members)))
    return sorted(out, key=repr)


def test_chat(spark, monkeypatch):
    table = spark.createDataFrame([(*r, "p", None) for r in CHATS], "conv_id long, turn long, role string, text string, piece string, part int")
    wanted = plain_chat(CHATS + chat_format.PROBE)
    parts = chat_format.format_conversations(chat_format.with_probe(table.repartition(3)))
    assert rows(chat_format.read_back(parts)) == wanted
    # All text under the mask, and nothing else, is what assistants say.
    shown = [r["formatted"][s["start"] : s["start"] + s["length"]] for r in parts.where("conv_id = 1").collect() for s in r["mask"]]
    assert [chat_format.unescape(s) for s in shown] == ["two </s> \\ <\\/s>"]
    assert parts.where("conv_id = 3").count() == 2
    empty = table.limit(0)
    assert chat_format.read_back(chat_format.format_conversations(empty)).count() == 0
    assert rows(chat_format.read_back(chat_format.format_conversations(chat_format.with_probe(empty)))) == plain_chat(chat_format.PROBE)


def test_chat_difference_stops_the_job(spark):
    table = spark.createDataFrame(CHATS[:3], "conv_id long, turn long, role string, text string")
    parts = chat_format.format_conversations(table)
    broken = parts.withColumn("formatted", F.regexp_replace("formatted", "kind", "mean"))
    with pytest.raises(Exception, match="does not read back"):
        chat_format.read_back(broken).collect()


def test_registered_sql_matches_on_control_strings():
    assert re.search("regexp_replace", chat_format.oracle_sql())
