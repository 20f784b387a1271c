"""Plain single-process versions of the operators, for small tables."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UP = bytes(range(65, 91))
LOW = bytes(range(97, 123))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def raw(text):
    return (text or "").encode()


def low(text):
    return raw(text).translate(bytes.maketrans(UP, LOW))


def least(ids):
    some = [i for i in ids if i is not None]
    return min(some) if some else None


def exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)
    out = []
    for i, t in docs:
        own = [x for x in groups[low(t)] if x is not None]
        keep = max(own) if own else None
        out.append((i, keep, len(groups[low(t)]), i == keep, sha(low(t))))
    return out


def fingerprint(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def simhash(docs):
    fps = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                up[root(b)] = root(a)
    members = defaultdict(list)
    for (i, _), f in zip(docs, fps):
        members[root(f)].append(i)
    return [(i, f"{f:016x}", least(members[root(f)])) for (i, _), f in zip(docs, fps)]


def order_key(row):
    return (row[0] is not None, row[0] or 0, raw(row[1]))


def substring(docs, window=20):
    seen, out = set(), []
    for i, t in sorted(docs, key=order_key):
        w = WORD.findall(raw(t))
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            gram = tuple(w[k:k + window])
            if gram in seen:
                gone[k:k + window] = [True] * window
            seen.add(gram)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix(docs, length=400):
    count = Counter()
    for _, t in docs:
        b = raw(t)
        count.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in docs:
        b = raw(t)
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def bpe(docs, encoding):
    out = []
    for i, t in docs:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(raw(t))))
    return out


def repair(rows):
    """Conversation repair by an automaton over suffixes: rows (conv, turn, role, text)."""
    import zlib

    found = defaultdict(list)
    for conv, turn, role, text in rows:
        own = found[conv]
        conv, role, text = (" " if x is None else x for x in (conv, role, text))
        draw = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks = set(), []
        for _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]+", "", text)
            marks.append("blank" if not shown else "duplicate" if (role, text) in seen else
                         "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        follow = {"B": {"s": "S", "u": "A"}, "S": {"u": "A"}, "A": {"a": "U"}, "U": {"u": "A"}}
        best = {"B": (0, "", ()), "U": (0, "", ())}
        for i in range(len(own), -1, -1):
            after, best = best, dict(best) if i == len(own) else {}
            if i < len(own):
                role, text = own[i][1:]
                stay = marks[i] not in ("blank", "duplicate")
                for p, q in after.items():
                    best[p] = min(best.get(p, (1 << 40,)), (q[0] + 3, "D" + q[1], q[2]))
                for p in "BSAU":
                    for c, to in follow[p].items() if stay else ():
                        if to in after and (c == role[:1] or c != "s"):
                            kept = c == role[:1]
                            name = role if kept else {"u": "user", "a": "assistant"}[c]
                            cost, audit, lines = after[to]
                            cost += (0 if kept else 2) + (marks[i] == "truncated")
                            best[p] = min(best.get(p, (1 << 40,)), (cost, "KR"[not kept] + audit, (f"{name}:{text}", *lines)))
            for _ in range(6):
                for p in "BSAU":
                    for c, to in follow[p].items():
                        if c != "s" and to in best:
                            cost, audit, lines = best[to]
                            name = {"u": "user", "a": "assistant"}[c]
                            best[p] = min(best.get(p, (1 << 40,)), (cost + 2, "I" + audit, (f"{name}:", *lines)))
        cost, audit, lines = best["B"]
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    sha("\n".join(lines).encode())))
    return out


def alignment(docs):
    """Token alignment of byte_bpe_50k.json and piece_bpe_32k.model, token by token."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    left = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    made, counts = [], Counter()
    for i, t in docs:
        a = left.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = right.encode(t) if t else []
        bytes_a = [bytes(code[c] for c in left.id_to_token(x)) for x in a]
        bytes_b = []
        for x in b:
            p = right.id_to_piece(x)
            bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        want = b" " + raw(t)
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for x in tokens:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], [0, 0]
        for hi in ends:
            parts = []
            for k, ids in enumerate((a, b)):
                own = []
                while at[k] < len(ids) and spans[k][at[k]][1] <= hi:
                    own.append(str(ids[at[k]]))
                    at[k] += 1
                parts.append(",".join(own))
            groups.append("|".join(parts))
        links, j0 = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while j0 < len(b) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        counts.update(links)
        made.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(i, na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
             sha(g.encode()) if g else "") for i, na, nb, ng, links, g in made]


def minhash(docs):
    """Jaccard of 3-word shingle sets, all pairs."""
    found = []
    for _, t in docs:
        w = WORD.findall(low(t))
        found.append({b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if both * 100 >= (len(a) + len(found[j]) - both) * 85 and a:
                up[root(i)] = root(j)
    members = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        members[root(k)].append(i)
    return [(i, len(found[k]), least(members[root(k)]), i == least(members[root(k)])) for k, (i, _) in enumerate(docs)]


def quality_statistics(text):
    """The classifier's statistics of one text, counted word by word."""
    data = (text or "").encode()
    words = re.findall(rb"[^ \t\v\f\r\n]+", data)
    punct, symbols = b".,;:'\"-()?", b"#$%&*+/<=>@[\\]^_`{|}~"

    def among(chars):
        return sum(byte in chars for byte in data)

    def share(test):
        return sum(bool(test(w)) for w in words) / max(len(words), 1)

    upper, lower = among(string.ascii_uppercase.encode()), among(string.ascii_lowercase.encode())
    has_upper, has_lower = re.compile(rb"[A-Z]").search, re.compile(rb"[a-z]").search
    n, w = max(len(data), 1), max(len(words), 1)
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / w,
        "upper": upper / max(upper + lower, 1), "digits": among(string.digits.encode()) / n, "punct": among(punct) / n,
        "bangs": among(b"!") / n, "symbols": among(symbols) / n, "wide": sum(byte > 127 for byte in data) / n,
        "lines": among(b"\n") / w, "caps_words": share(lambda x: has_upper(x) and not has_lower(x) and len(x) > 1),
        "title_words": share(lambda x: has_upper(x[:1]) and has_lower(x)), "symbol_ends": share(lambda x: x[-1] in symbols),
        "bang_ends": share(lambda x: x[-1] in b"!"), "stop_ends": share(lambda x: x[-1] in punct),
        "bare_symbols": share(lambda x: len(x) == 1 and x[0] in symbols),
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / w, "distinct": len(set(words)) / w}


def quality_score(text, model, names):
    """The rules of a fitted model applied to one text."""
    stats = quality_statistics(text)
    total = model["bias"] + sum(weight for rule, weight in model["rules"]
                                if all((stats[names[i]] > at) == above for i, above, at in rule))
    return 1 / (1 + math.exp(-total))
