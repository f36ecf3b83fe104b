"""Alignment, hard negatives and chat formatting against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import align, chat, hard_negatives

# ---- op11 ---------------------------------------------------------------------------------------------

EXTRA = "doc_id bigint, text string, key string, block bigint, code string"


@pytest.fixture(scope="module")
def tokenizers(spark):
    return align.Tokenizers(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def tiles(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def aligned_one_by_one(rows, t):
    """The contract, by whole-text encoding and all pairs of overlapping intervals of a text."""
    links, head = {}, {}
    for n, (i, text) in enumerate(rows):
        a = b = []
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            if not b"".join(t.bytes_a[x] for x in a) == (" " + text).encode() == b"".join(t.bytes_b[x] for x in b):
                a = b = []
        x, y = tiles(a, t.bytes_a), tiles(b, t.bytes_b)
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for s, e, k in side if low <= s and e <= c) for side in (x, y)))
            low = c
        lo = 0
        links[n] = []
        for s, e, k in x:
            while lo < len(y) and y[lo][1] <= s:
                lo += 1
            links[n] += [(k, m) for u, v, m in y[lo:lo + 300] if u < e and s < v]
        head[n] = (i, len(a), len(b), len(cuts), len(links[n])), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
    count = Counter(p for own in links.values() for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((*head[n][0], sum(count[p] == best[p[1]] for p in links[n]), sum(count[p] for p in links[n]), head[n][1])
                   for n in head), key=str)


def strings(seed=3):
    rnd = random.Random(seed)
    atoms = ["the", "Émile", "don't", "x2y", "  ", " ", "\n", "\t", " ", "　", "▁", "ﬁ", "日本語", "🙂", "<s>", "<|endoftext|>",
             "<0x41>", "é", "\x1c", "​", "\x85", "ß", "1234567", "...", "'ll", "́", "\x00", "᠎", "Ǆ", "½"]
    out = ["", None, " ", "  ", "a", " a", "a ", "a  b ", "\n", "word " * 400, "x" * 3000, "a b", "a b", "▁x y"]
    out += ["".join(rnd.choice(atoms) + rnd.choice(["", "", " ", "  "]) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    return out


def test_alignment_is_that_of_whole_texts(spark, tokenizers):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(strings())] + [(1, "word again"), (1, "word again")]
    df = spark.createDataFrame([(i, t, "k", 0, "c") for i, t in rows], EXTRA).repartition(3)
    want = aligned_one_by_one(rows, tokenizers.loaded())
    for texts in (align.BLOCK_TEXTS, 7):
        got = sorted((tuple(r) for r in align.align(df, tokenizers, block_texts=texts).collect()), key=str)
        assert got == want


def test_alignment_of_an_empty_table(spark, tokenizers):
    df = spark.createDataFrame([], EXTRA)
    assert align.align(df, tokenizers).collect() == []
    texts = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r)[1:] for r in align.align(texts, tokenizers).collect()) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pair_table_counts_links(spark, tokenizers):
    df = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, "words")], "doc_id bigint, text string")
    pairs = align.pair_table(align.aligned_blocks(df, tokenizers, block_texts=1), tokenizers).collect()
    t = tokenizers.loaded()
    named = {(t.bytes_a[r.a_id], t.bytes_b[r.b_id]): (r.links, r.best) for r in pairs}
    assert named[b" words", b" words"] == (3, True) and named[b" same", b" same"] == (2, True)


def test_both_encoders_of_a_agree(tokenizers):
    t = tokenizers.loaded()
    assert t.ranked is not None
    for text in strings(5) + [chr(c) for c in range(0x20, 0x250)]:
        if text and align._SETTLED.fullmatch(text):
            for x in (text, f"a{text}b", f"1 {text} .{text}"):
                assert t.ranked.encode_ordinary(x) == t.a.encode(x, add_special_tokens=False).ids


def test_coalesced_groups():
    al = align.coalesce(np.array([2, 3, 6, 7]), np.array([1, 3, 4, 5, 6, 7]))
    assert al.group.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert list(zip(al.a.tolist(), al.b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4), (3, 5)]


# ---- op12 ---------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, row string, q string, slot int"


def mined_one_by_one(rows, step=100):
    part = [(n, i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], lab) for n, (i, v, lab) in enumerate(rows)
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v, lab in part:
        if i % step:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w)), j, m, lb) for m, j, w, lb in part if m != n)
        for p, pid, _, _ in [s for s in score if s[3] == lab][:5]:
            near = [s for s in score if s[3] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j, _, _) in enumerate(near)]
    return sorted(out)


def odd_vectors(n=260, seed=2):
    rnd = np.random.default_rng(seed)
    rows = [(i * 4, (rnd.normal(size=8) * 0.3 + 0.2).astype(np.float32).tolist(), int(rnd.integers(3))) for i in range(n)]
    rows += [(4 * i + 1, rows[i][1], rows[i][2]) for i in range(0, n, 5)]           # copies: ties
    rows += [rows[0], rows[25], rows[25]]                                            # repeated rows
    rows += [(3, None, 1), (7, [1.0, None], 1), (11, [float("nan")] * 8, 1), (13, [float("inf")] * 8, 1), (15, [0.5] * 8, None),
             (None, [0.5] * 8, 1), (17, [], 1), (19, [0.9, 0.8], 2), (400, [0.0] * 8, 0), (500, [], 1)]
    return rows


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "r", "q", 1) for i, v, lab in rows], VECTORS).repartition(4)
    return sorted(tuple(r) for r in hard_negatives.mine(df).collect())


def test_hard_negatives(spark):
    rows = odd_vectors()
    want = mined_one_by_one(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_hard_negatives_of_large_components(spark):
    rows = [(i, v and [x * 3e6 if x is not None else None for x in v], lab) for i, v, lab in odd_vectors(60, 4)]
    assert mined(spark, rows) == mined_one_by_one(rows)


def test_no_hard_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


@pytest.mark.parametrize("top", [1, 300, 2**20, 2**29, 2**35, 2**63 - 1])
def test_packed_products_are_exact(top):
    rnd = random.Random(top)
    for low, high in ((-top, top), (0, top), (-top, -top), (-top, 0)):
        a, c = ([[rnd.randint(low, high) for _ in range(7)] for _ in range(n)] for n in (5, 33))
        got = hard_negatives.products(np.array(a, np.int64), np.array(c, np.int64))
        exact = [[sum(x * y for x, y in zip(u, v)) for v in c] for u in a]
        assert got.tolist() == [[min(max(x, -2**63), 2**63 - 1) for x in u] for u in exact]


def test_both_widths_agree():
    rnd = np.random.default_rng(1)
    a, c = rnd.integers(-160, 160, (9, 64)), rnd.integers(-160, 160, (1300, 64))
    want = a @ c.T
    assert (hard_negatives.products(a, c) == want).all() and (hard_negatives._in_wide_integers(a, c) == want).all()


def test_kept_best_over_blocks():
    rnd = np.random.default_rng(1)
    scores, ids = rnd.integers(0, 30, (6, 900)), rnd.permutation(900)
    best = hard_negatives._Best(6, 10)
    for lo in range(0, 900, 300):
        found = type("R", (), {"ids": ids[lo:lo + 300], "rows": ids[lo:lo + 300]})
        best.offer(scores[:, lo:lo + 300], np.ones((6, 300), bool), found)
    for i in range(6):
        want = sorted(zip(-scores[i], ids))[:10]
        assert list(zip(-best.score[i], best.id[i])) == want


# ---- op13 ---------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, part string, piece int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formatted_one_by_one(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def conversations(seed=1):
    rnd = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "<|", "é", "🙂", " ok", ""]
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if c % 3 else ("user", "assistant")[t % 2],
                         "".join(rnd.choices(bits, k=rnd.randint(0, 9)))))
    rows += [(50, 0, "user", None), (50, 0, "user", None), (50, None, None, "x"), (51, 0, "a\nb\\n<|im_end|>", "<"), (None, 0, "user", "n"),
             (None, 1, "assistant", "n"), (52, 0, "assistant", "y" * 50_000), (53, 1, "user", "b"), (53, 1, "user", "a")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"turn {t} " + rnd.choice(bits)) for t in range(500)]     # a third of all
    return rows


@pytest.mark.parametrize("piece_chars", [chat.PIECE_CHARS, 300])
def test_conversations_read_back(spark, piece_chars):
    rows = conversations()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS).repartition(6)
    formatted = chat.format_conversations(df, piece_chars=piece_chars).collect()
    got = chat.digest(chat.format_conversations(df, piece_chars=piece_chars)).collect()
    want = formatted_one_by_one(rows)
    assert len(got) == len(want) and {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    for r in formatted:
        assert sum(s.chars for s in r.segments) == len(r.text)
    for c in want:
        own = sorted((r for r in formatted if r.conv_id == c), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        assert next(r.formatted_chars for r in got if r.conv_id == c) == sum(len(r.text) for r in own)
    assert (max(r.piece for r in formatted) > 0) == (piece_chars == 300)


def test_role_machine(spark):
    cases = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user",
             6: "system assistant", 7: "user assistant tool assistant", 8: "user robot assistant"}
    df = spark.createDataFrame([(c, i, r, "t") for c, rs in cases.items() for i, r in enumerate(rs.split())],
                               "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 1), 7: (True, None), 8: (False, 1)}


def test_no_conversations(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def test_other_templates(spark):
    template = chat.Template(opening="<|turn|>", closing="<|/turn|>", loss_roles=frozenset({"bot"}),
                             follows={"begin": ("me",), "me": ("bot",), "bot": ("me",)}, ends=frozenset({"bot"}))
    df = spark.createDataFrame([(1, 0, "me", "<|turn|>"), (1, 1, "bot", "<|/turn|> x")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df, template).first()
    assert row.text == "<|turn|>me\n<\\|turn|><|/turn|><|turn|>bot\n<\\|/turn|> x<|/turn|>" and row.valid
    assert [(s.chars, s.loss) for s in row.segments if s.loss] == [(12, True)]
    assert list(template.turns(row.text)) == [("me", "<|turn|>"), ("bot", "<|/turn|> x")]


def test_escapes_round_trip():
    rnd = random.Random(0)
    for _ in range(3000):
        text = "".join(rnd.choices("<|\\an\n", k=rnd.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
