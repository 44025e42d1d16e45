"""Plain versions of stages, for small inputs."""

import re

#: The base patterns as the contract writes them.
BASE = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "CARD": r"[0-9]([\x20-]?[0-9])+",
    "PHONE": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "IP":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "CARD":
        doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "EMAIL" or 9 <= len(digits) <= 15


def personal(text):
    """text with valid base matches replaced; where two overlap the earlier one counts."""
    spans = sorted((m.start(), list(BASE).index(k), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0]))
    out, at = "", 0
    for a, _, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k}>"
        at = max(at, b)
    return out + text[at:]


def base_spans(text):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0]))


def discovered(texts, rounds=3, confidence=0.6, least_seeds=3, purity=0.8):
    """For each text its added (start, kind, end): patterns and instances scored in plain loops."""
    occurs, met = {}, []
    for k, text in enumerate(texts):
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            occurs[w] = occurs.get(w, 0) + 1
        last, base = 0, base_spans(text)
        for m in re.finditer(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*(\x20[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*)*", text):
            before, last = re.findall(r"[^\W\d_]+", text[last : m.start()].lower()), m.end()
            a = m.start() + len(re.match(r"(?:[^\w+(]|_)*", m[0])[0])
            b = max(a, m.end() - len(re.search(r"(?:[^\w)]|_)*$", m[0])[0]))
            word = text[a:b]
            kind = 2 if "@" in word else int(len(re.sub("[^0-9]", "", word)) >= 5)
            if before and word and kind:
                seeds = [s[1] for s in base if s[0] < b and a < s[2]]
                met.append((k, a, b, (before[-1], kind), word, seeds[0] if seeds else None))
    good = {}
    for pattern in {x[3] for x in met}:
        seeds = {x[4]: x[5] for x in met if x[3] == pattern and x[5] is not None}
        counts = [list(seeds.values()).count(j) for j in range(4)]
        if sum(counts) >= least_seeds and max(counts) >= purity * sum(counts):
            good[pattern] = counts.index(max(counts))
    own = [x for x in met if x[3] in good]
    share = lambda pattern, score: sum(score(x) for x in own if x[3] == pattern) / (occurs[pattern[0]] + 1)
    p = {g: share(g, lambda x: x[5] is not None) for g in good}
    for _ in range(rounds - 1):
        scores = {}
        for x in own:
            scores[x[4]] = max(scores.get(x[4], 0), 1 if x[5] is not None else p[x[3]])
        p = {g: share(g, lambda x, s=scores: s[x[4]]) for g in good}
    out = [set() for _ in texts]
    for k, a, b, pattern, _, seed in own:
        if seed is None and p[pattern] >= confidence:
            out[k].add((a, good[pattern], b))
    return out
