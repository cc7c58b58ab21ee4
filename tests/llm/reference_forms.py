"""Plain single-machine forms of the contracts, written apart from the operators, for comparison."""

import base64
import datetime
import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(folded(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = WORD.findall(folded(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        names = sorted(str(x) for x in found)
        out[doc] = (len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0)
    return out


def simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, threshold=2):
    """doc -> (fingerprint, least doc reachable), comparing all pairs."""
    docs = sorted(fps)
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", root(d)) for d in docs}


def bpe(docs):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for doc, text in docs:
        ids = encoding.encode_ordinary(text or "")
        out[doc] = (len(ids), sha(" ".join(map(str, ids))), sha(encoding.decode_bytes(ids)))
    return out


def chat(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss))
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return folded(host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def url_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def edited(docs):
    """doc -> (n_chars, digest of the edited text)."""
    rows = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for (d, t), (_, other) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out[d] = (len(t), sha(t[: len(t) - half] + other[:half]), other)
    return out


def deduped_lines(docs, n=3):
    """(doc, text) rows in order -> texts, by the first occurrence of every window of n lines."""
    seen, out = {}, {}
    for d, t in sorted(docs):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - n + 1):
            w = tuple(lines[i : i + n])
            if any(x.strip(" ") for x in w) and seen.setdefault(w, (d, i)) != (d, i):
                gone.update(range(i, i + n))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def near_sets(sets, threshold):
    """key -> least key reachable over pairs of sets with a Jaccard of `threshold` or more, comparing all pairs."""
    keys = sorted(sets)
    label = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            union = sets[a] | sets[b]
            if label[a] != label[b] and (not union or len(sets[a] & sets[b]) / len(union) >= threshold):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def shingle_sets(docs, n=5):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
        out[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def chains(text, anchors, chain=2):
    """SpotSigs before hashing: what follows each anchor, cut to content words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            out.add(tuple([w] + [x for x in words[i + 1 :] if x not in anchors][:chain]))
    return out or ({tuple(words)} if words else set())


# --- pseudonyms, in one pass over the text and with permutations written as arithmetic


def feistel(value, size, key, tweak):
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    salt = hashlib.blake2b(tweak.encode(), digest_size=16).digest()
    while True:
        left, right = divmod(value, 2**half)
        for r in range(8):
            n = (half + 7) // 8
            f = int.from_bytes(hashlib.blake2b(right.to_bytes(n, "big"), key=key, person=bytes([r]), salt=salt, digest_size=min(64, n + 8)).digest(), "big")
            left, right = right, left ^ (f % 2**half)
        value = left * 2**half + right
        if value < size:
            return value


def _put(shape, digits):
    digits = list(digits)
    return re.sub("[0-9]", lambda m: digits.pop(0), shape)


def _luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
    return total % 10 == 0


def _pseudo(kind, s, key):
    d = re.sub("[^0-9]", "", s)
    if kind == "date":
        p = re.split("[-./]", s)
        y, m, day = (p[0], p[1], p[2]) if len(p[0]) == 4 else (p[2], p[0], p[1]) if "/" in s and int(p[0]) <= 12 else (p[2], p[1], p[0])
        try:
            at = datetime.date(int(y), int(m), int(day))
        except ValueError:
            return None
        if not 1900 <= at.year <= 2099:
            return None
        days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(73049)]
        own = [x for x in days if (x.day <= 12) == (at.day <= 12)]
        new = own[feistel(own.index(at), len(own), key, "date:12" if at.day <= 12 else "date:31")]
        form = "ymd" if len(p[0]) == 4 else "mdy" if "/" in s and int(p[0]) <= 12 else "dmy"
        return _put(s, "".join({"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}[c] for c in form))
    if kind == "card":
        if not 13 <= len(d) <= 19 or not _luhn(d) or not int(d):
            return None
        body = int(d[:-1])
        while True:
            body = feistel(body, 10 ** (len(d) - 1), key, f"card{len(d) - 1}")
            if body:
                break
        text = str(body).zfill(len(d) - 1)
        return _put(s, text + next(c for c in "0123456789" if _luhn(text + c)))
    if kind == "phone":
        code = ""
        if s[0] == "+":
            code = d[: 1 if d[0] in "17" else 2 if d[:2] in "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split() else 3]
        own = d[len(code) :]
        if not 8 <= len(d) <= 15 or len(own) < 6:
            return None
        return _put(s, code + str(feistel(int(own), 10 ** len(own), key, f"phone{code or 1}:{len(own)}")).zfill(len(own)))
    if kind == "social":
        fine = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        if not fine(d):
            return None
        while True:
            d = str(feistel(int(d), 10**9, key, "social")).zfill(9)
            if fine(d):
                return _put(s, d)
    if kind == "ipv4":
        parts = s.split(".")
        if any(int(x) > 255 or (x != "0" and x[0] == "0") for x in parts):
            return None
        sizes = [{1: 10, 2: 90, 3: 156}[len(x)] for x in parts]
        least = [{1: 0, 2: 10, 3: 100}[len(x)] for x in parts]
        value = size = None
        for x, n, low in zip(parts, sizes, least):
            value, size = (int(x) - low, n) if size is None else (value * n + int(x) - low, size * n)
        value = feistel(value, size, key, "ipv4" + "".join(str(len(x)) for x in parts))
        out = []
        for n, low in list(zip(sizes, least))[::-1]:
            out.insert(0, str(low + value % n))
            value //= n
        return ".".join(out)
    if kind == "hex":
        if s.isdigit() or s.isalpha():
            return None
        value = int(s, 16)
        while True:
            value = feistel(value, 16 ** len(s), key, f"hex{len(s)}")
            text = f"{value:x}".zfill(len(s))
            if not (text.isdigit() or text.isalpha()):
                return text.upper() if s.upper() == s else text
    if kind == "iban":
        p = s.replace(" ", "")
        rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if not 15 <= len(p) <= 34 or rest(p) != 1:
            return None
        own = re.sub("[^0-9]", "", p[4:])
        moved = str(feistel(int(own or "0"), 10 ** max(1, len(own)), key, f"iban{p[:2]}{len(own)}")).zfill(len(own))
        account = _put(p[4:], moved)
        new = next(x for x in (f"{p[:2]}{k:02}{account}" for k in range(2, 99)) if rest(x) == 1)
        return "".join(" " if c == " " else new[i - s[:i].count(" ")] for i, c in enumerate(s))
    local, domain = s.rsplit("@", 1)
    low = [c.lower() if "A" <= c <= "Z" else c for c in local]
    classes = ["".join(map(chr, range(48, 58))) if c in "0123456789" else "".join(map(chr, range(97, 123))) if "a" <= c <= "z" else "" for c in low]
    value, size = 0, 1
    for c, k in zip(low, classes):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    if size == 1:
        return None
    value = feistel(value, size, key, "mail" + "".join(k[0] if k else "x" for k in classes))
    out = list(local)
    for i in reversed(range(len(out))):
        if classes[i]:
            value, at = divmod(value, len(classes[i]))
            out[i] = classes[i][at].upper() if out[i].isupper() else classes[i][at]
    return "".join(out) + "@" + domain


#: What candidates look like, in the order in which kinds win where they begin together: fixed formats.
_LOOKS = {
    "mail": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?!\w)",
    "hex": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![\w-]|\.\d)",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.\d)",
    "social": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![\w-]|\.\d)|(?<![\w+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?|\([0-9]{3}\))(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)",
    "card": r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?![\w])",
}


def pseudonymous(text, key):
    found = []
    for rank, (kind, looks) in enumerate(_LOOKS.items()):
        for m in re.finditer(looks, text):
            new = _pseudo(kind, m[0], key)
            if new is not None:
                found.append((m.start(), rank, m.end(), new))
    out, at = "", 0
    for begin, _, end, new in sorted(found):
        if begin >= at:
            out, at = out + text[at:begin] + new, end
    return out + text[at:]


def aligned(docs):
    """doc -> the contract's row of op11, from whole texts by the plain libraries, with sets of byte offsets."""
    import public_tokenizers as files
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def bytes_of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    out, linked, holders = {}, {}, {}
    for d, t in docs:
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        raw = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes_of_b(i) for i in ids[1]]]
        if not t or any(b"".join(r) != (" " + t).encode() for r in raw):
            out[d], linked[d] = (0, 0, 0, 0, ""), Counter()
            continue
        ends = [list(accumulate(map(len, r))) for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for i, e in zip(ids[side], ends[side]):
                groups[bisect_left(cuts, e)][side].append(i)
        linked[d] = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in linked[d]:
            holders[pair] = holders.get(pair, 0) + 1
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[d] = (len(ids[0]), len(ids[1]), len(groups), sum(linked[d].values()), sha(said))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(n, best.get(x, 0))
    return {d: (*out[d], sum(n for p, n in own.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in own.items())) for d, own in linked.items()}


def runs_of(words):
    """(start, length, smallest period) of every run, by comparing words for each period in turn."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in seen.items())


def periodic(doc, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if h % 10 == 0 and words:
        a = (h // 10) % len(words)
        p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    runs = runs_of(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def shingles_of(text, n=4):
    words = re.findall("[^\\x20\\x09-\\x0D]+", folded(text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
