"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import math
import re
import zlib


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows, width, limit=80):
    """doc_id to (set size, smallest id that it is connected with), all pairs compared."""
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= limit * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m.group()))


def joined(spans):
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def unigram(rows, held):
    """doc_id to (tokens, known, training tokens, base score)."""
    count = collections.Counter()
    for d, t in rows:
        if not held(d):
            count.update(words(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        w = [*words(t), None]
        out[d] = (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    return out


def disclosed(texts, context, letters, generalise, remove):
    """Index of a text to its disclosing spans (start, end, action) by the definition, all texts looked through."""
    spans = [base_spans(t) for t in texts]
    held, near, near_at = collections.defaultdict(set), collections.defaultdict(set), []
    for i, t in enumerate(texts):
        found = set()
        for a, k, b in spans[i]:
            value = t[a:b]
            for e in ((k,), (k, value)):
                held[e].add(t)
            for m in re.finditer(r"[^\W\d_]+", t):
                inside = a - context <= m.start() and m.end() <= a or b <= m.start() and m.end() <= b + context
                whole = len(m.group()) >= letters and not any(x < m.end() and y > m.start() for x, _, y in spans[i])
                if inside and whole:
                    found.add((m.group().lower(), k, m.start(), m.end()))
                    for e in ((k,), (k, value)):
                        near[m.group().lower(), e].add(t)
        near_at.append(found)
    every = set(texts)
    seen = collections.Counter(w for t in every for w in {m.lower() for m in re.findall(r"[^\W\d_]+", t)})
    action = {}
    for (w, e), there in near.items():
        content = math.log2(len(every) / len(held[e]))
        if len(there) > 1 and content:
            share = math.log2((len(there) - 1) / seen[w] * len(every) / len(held[e])) / content
            if share >= generalise:
                action[w, e] = "remove" if share >= remove else "generalise"
    out = []
    for i, t in enumerate(texts):
        got = {}

        def add(a, b, what, got=got):
            got[a, b] = max(got.get((a, b), ""), what)

        for w, k, a, b in near_at[i]:
            if (w, (k,)) in action:
                add(a, b, action[w, (k,)])
        for m in re.finditer(r"[^\W\d_]+", t):
            if not any(x < m.end() and y > m.start() for x, _, y in spans[i]):
                for e in {(k, t[a:b]) for a, k, b in spans[i]}:
                    if (m.group().lower(), e) in action:
                        add(m.start(), m.end(), action[m.group().lower(), e])
        out.append({(a, b, w) for (a, b), w in got.items()})
    return out


UNITS = set("mm cm m km inch inches ft feet foot yard yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph w kw kwh v volt volts".split())


def template(text):
    """(kind, lower-cased word) of each word: number, unit, name, or the word itself."""
    out, last = [], None
    for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or ""):
        word, low = m.group(), m.group().lower()
        kind = low
        if re.fullmatch("[0-9]+[a-z]{0,2}", low):
            kind = 1
        elif low in UNITS:
            kind = 2
        elif last is not None and "A" <= word[0] <= "Z" and len(word) > 1 and ("a" <= word[1] <= "z" or word[1] > "\x7f") and not set(text[last : m.start()]) & set('.!?:;\n"'):
            kind = 3
        out.append((kind, low))
        last = m.end()
    return out


def one_to_one(pairs):
    there, back = {}, {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in pairs)


def leak(item, doc, m):
    """(windows, of_windows) of an item's best alignment with a document that is a leak, or None. m: the operator's bounds."""
    width = min(m.WINDOW, len(item))
    n = len(item) - width + 1
    if not width or len(doc) < width or width < m.ANYWHERE and len(doc) > width:
        return None
    kinds, words = [k for k, _ in item], [w for _, w in item]
    dk, dw = [k for k, _ in doc], [w for _, w in doc]
    plain = lambda a: sum(isinstance(k, str) for k in kinds[a : a + width])
    tells = [a for a in range(n) if width >= m.SHORTEST and plain(a) >= min(m.PLAIN, width)]
    best = None
    for shift in range(-n + 1, len(doc) - width + 1):
        inside = [a for a in range(n) if 0 <= a + shift <= len(doc) - width]
        equal = [a for a in inside if words[a : a + width] == dw[a + shift : a + shift + width]]
        alike = [a for a in inside if kinds[a : a + width] == dk[a + shift : a + shift + width]]
        slots = lambda a, b, shift=shift: [(words[i], dw[i + shift]) for i in range(a, b) if not isinstance(kinds[i], str)]
        found = None
        both = sorted({*equal, *alike})
        told = [a for a in both if a in tells]
        if len(equal) >= min(m.LEAST_WINDOWS, m.LEAST_SHARE * n):
            found = len(equal), n
        elif width < m.SHORTEST:
            pass
        elif len(both) == n and len(tells) < n and one_to_one(slots(0, len(item))) and sum(isinstance(k, str) for k in kinds) >= m.PLAIN_ITEM:
            found = n, n
        elif told and len(told) >= min(m.LEAST_WINDOWS, m.LEAST_SHARE * len(tells)):
            if one_to_one(slots(told[0], told[-1] + width)):
                found = len(told), len(tells)
            else:
                runs = [j - i + 1 for i in range(len(told)) for j in range(i, len(told)) if one_to_one(slots(told[i], told[j] + width))]
                if max(runs, default=0) >= 2 * m.LEAST_WINDOWS:
                    found = max(runs), len(tells)
        if found and (best is None or found[0] > best[0]):
            best = found
    return best
