"""Plain versions of the corpus operators, by brute force."""

import datetime
import hashlib
import re
from collections import Counter

import numpy as np

from parlance.llm import pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def removal(texts, n):
    """For each text (bytes): bytes, removed, runs, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def near(rows, n=5, threshold=0.8):
    """id -> (class, links, copies) for rows of (id, text), ids unique."""
    words = {i: tuple(w.lower() for w in WORD.findall((t or "").lower())) for i, t in rows}
    same = {}
    for i, w in words.items():
        same.setdefault(w or (None, i), []).append(i)
    sets = {min(v): (frozenset(w[k : k + n] for k in range(len(w) - n + 1)) or frozenset([w])) if w[0] is not None else frozenset() for w, v in same.items()}
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9} for i in ids}
    group = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in links[i]:
                group[i] = group[j] = min(group[i], group[j])
    return {i: (group[min(v)], len(links[min(v)]), len(v)) for v in same.values() for i in v}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def feistel(key, tweak, left, right, a, b):
    for i in range(8):
        x = right if i % 2 == 0 else left
        drawn = int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + drawn) % a
        else:
            right = (right + drawn) % b
    return left, right


def permuted(key, kind, digits):
    u = len(digits) // 2
    left, right = feistel(key, f"{kind}|{len(digits)}", int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u))
    return f"{left:0{u}d}{right:0{len(digits) - u}d}"


# --- pseudonyms: the matching of pii.py with plain loops ---


def _refill(m, digits, skip=0):
    it, n, out = iter(digits), 0, ""
    for c in m:
        if c in "0123456789":
            n += 1
            out += next(it) if n > skip else c
        else:
            out += c
    return out


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _date_of(m):
    one, two, three = (int(x) for x in re.split("[-/.]", m))
    year_first = bool(re.match("[0-9]{4}", m))
    day_first = not year_first and (one > 12 or "." in m)
    y, mo, d = (one, two, three) if year_first else (three, two, one) if day_first else (three, one, two)
    try:
        day = datetime.date(y, mo, d)
    except ValueError:
        return None
    return (day, year_first, day_first) if 1800 <= y <= 2199 else None


def _only(m):
    return re.sub("[^0-9]", "", m)


def pseudonym(key, kind, m):
    sha = lambda what, x: hashlib.sha256(f"{key}|{what}|{x}".encode()).hexdigest()
    letters = lambda what, x, n: sha(what, x.lower())[:n].translate(str.maketrans("0123456789", "ghijklmnop"))
    digits = _only(m)
    if kind == "email":
        return f"u{letters('email', m, 24)}@d{letters('host', m.rsplit('@', 1)[1], 16)}.invalid"
    if kind == "secret":
        new = sha("secret", m.lower())[: len(m)]
        return new if re.search("[a-f]", m) else new.upper()
    if kind == "ip":
        p = [int(x) for x in m.split(".")]
        left, right = feistel(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        day, year_first, day_first = _date_of(m)
        n = (day - first).days
        left, right = feistel(key, "date", n // 773, n % 773, 189, 773)
        new = first + datetime.timedelta(left * 773 + right)
        sep = re.search("[-/.]", m).group()
        w = 1 if any(len(x) == 1 for x in m.split(sep)) else 2
        y, mo, d = f"{new.year:04d}", f"{new.month:0{w}d}", f"{new.day:0{w}d}"
        return sep.join((y, mo, d) if year_first else (d, mo, y) if day_first else (mo, d, y))
    if kind == "tax":
        areas = [a for a in range(1, 900) if a != 666]
        left, right = feistel(key, "tax", areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1, int(digits[5:]) - 1, 898 * 99, 9999)
        return f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "card":
        body = permuted(key, "card", digits[:-1])
        return _refill(m, body + str(-_luhn(body + "0") % 10))
    if kind == "iban":
        rest = m[4:]
        if len(_only(rest)) >= 2:
            rest = _refill(rest, permuted(key, "iban", _only(rest)))
        return f"{m[:2]}{98 - _mod97(rest.replace(' ', '') + m[:2] + '00'):02d}{rest}"
    if kind == "phone":
        code = re.match(pii._CALLING, m)
        skip = len(code.group(1)) if code else 0
        return _refill(m, permuted(key, "phone", digits[skip:]), skip)
    return m


def _kind(m):
    if "@" in m:
        return "email"
    if re.fullmatch("[0-9A-Fa-f]{32,64}", m):
        return "secret"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        return "ip" if all(int(x) < 256 for x in m.split(".")) else None
    if re.fullmatch(pii._DATE, m):
        return "date" if _date_of(m) else None
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return None if re.match("000|666|9", m) or m[4:6] == "00" or m[7:] == "0000" else "tax"
    return "phone" if 9 <= len(_only(m)) <= 18 else None


def _check(s, printed):
    card = re.search(pii._PRINTED if printed else r"^[0-9](?:[ \-]?[0-9]){12,18}$", s)
    if card:
        return "card" if _luhn(_only(s)) % 10 == 0 else None
    compact = s.replace(" ", "")
    if re.fullmatch(pii._IBAN, s) and (not printed or s[:2] in pii._IBAN_LENGTHS.get(len(compact), "").split()):
        return "iban" if _mod97(compact[4:] + compact[:4]) == 1 else None
    return None


def _bare(s):
    return s[:-1] if s[-1:] in (" ", "-") else s


def _valued(kind, s):
    return [(kind, _bare(s)), (None, s[len(_bare(s)) :])]


def _search(m, printed=True):
    words = re.findall(r"[ \-]?\+?[0-9A-Z]*+[ \-]?(?<=.)", m)
    out, free, i = [], 0, 0
    gap = lambda a, b: ([] if a == b else _others("".join(words[a:b])) if printed else [(None, "".join(words[a:b]))])
    while i < len(words):
        for j in range(min(i + 18, len(words) - 1), i - 1, -1) if re.match("[0-9A-Z]", words[i]) else ():
            s = _bare("".join(words[i : j + 1]))
            kind = _check(s, printed) if 12 <= len(s) <= 48 else None
            if kind:
                out += gap(free, i) + _valued(kind, "".join(words[i : j + 1]))
                free = i = j + 1
                break
        else:
            i += 1
    return out + gap(free, len(words))


def _others(m):
    kind = _check(_bare(m), False) if len(m) <= 48 else None
    if kind:
        return _valued(kind, m)
    pattern = f"{pii._TAX}|{pii._PHONE}"
    out, found = [], re.findall(pattern, m)
    for i, p in enumerate(re.split(pattern, m)):
        out += _search(p, False) if p else []
        out += [(_kind(found[i]), found[i])] if i < len(found) else []
    return out


def pseudonymised(text, key):
    """(kinds in order, new text)."""
    kinds, out, at = [], "", 0
    for hit in re.finditer(pii.PATTERN, text):
        m = hit.group()
        grouped = re.fullmatch(r"\+?[0-9A-Z]++(?:[ \-][0-9A-Z]++)*+", m) and not re.fullmatch(rf"[0-9A-Fa-f]{{32,64}}|{pii._DATE}|{pii._TAX}", m)
        out += text[at : hit.start()]
        for kind, s in _search(m) if grouped else [(_kind(m), m)]:
            out += pseudonym(key, kind, s)
            kinds += [kind] if kind else []
        at = hit.end()
    return kinds, out + text[at:]


# --- URL filter ---


def url_verdicts(urls, rules):
    """(rule, verdict, score) of each URL and the cut, with dictionaries of counts."""
    import math
    import zlib

    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    def parts(url):
        if "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return low(host), re.match(r"[^?#]*", rest[len(host) :]).group()

    def fold(b):
        c = chr(b)
        if c.isascii() and c.isalpha():
            return 1 + ord(c.lower()) - 97
        return 27 if c.isascii() and c.isdigit() else 28 + "-./?=&_%#:+~".index(c) if c in "-./?=&_%#:+~" else 40

    def steps(url):
        s = (0, 0, 0, *map(fold, url.encode()))
        return [(s[i - 3 : i], s[i]) for i in range(3, len(s))]

    ruled, aside, learn = [], [], {True: [], False: []}
    for url in urls:
        host, path = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        ruled.append((host, path, best))
        if best:
            (aside.append((url, best.verdict == "allow")) if zlib.crc32(host.encode()) % 4 == 3 else learn[best.verdict == "allow"].append(url))
    count = {side: {} for side in learn}
    for side, own in learn.items():
        for url in own:
            for before, c in steps(url):
                for k in range(4):
                    cell = count[side].setdefault(before[3 - k :], {})
                    cell[c] = cell.get(c, 0) + 1

    def p(side, before, c):
        out = 1 / 41
        for k in range(4):
            cell = count[side].get(before[3 - k :])
            if not cell:
                break
            out = (cell.get(c, 0) + len(cell) * out) / (sum(cell.values()) + len(cell))
        return out

    def score(url):
        if not (learn[True] and learn[False] and url):
            return 0.0
        got = [math.log(p(True, b, c)) - math.log(p(False, b, c)) for b, c in steps(url)]
        return sum(got) / len(got)

    return [(h, x, b.name if b else None, b.verdict if b else None, score(u)) for u, (h, x, b) in zip(urls, ruled)], [(score(u), side) for u, side in aside]
