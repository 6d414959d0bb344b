"""Row-at-a-time restatements of the rules, for comparison on small inputs."""

from collections import Counter

SECTION_LEVELS = ("Title", "H1", "H2", "H3")
STEPS = ("ingredients", "instructions", "method")


def mode(values):
    return Counter(values).most_common(1)[0][0] if values else None


def quantile(values, q):
    ordered = sorted(values)
    place = (len(ordered) - 1) * q
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def body_size(values):
    if not values:
        return 12.0
    low, high = quantile(values, 0.25), quantile(values, 0.75)
    return mode([v for v in values if low <= v <= high] or values)


def clamp(levels):
    seen, out = 0, []
    for level in levels:
        if level.startswith("H"):
            number = min(int(level[1:]), seen + 1)
            seen = number
            level = f"H{number}"
        elif level == "Title":
            seen = 0
        out.append(level)
    return out


def sections(lines):
    """``lines``: (page, text, level) of one document; gives (title, page, content)."""
    found, current = [], None
    for page, text, level in lines:
        opens = level in SECTION_LEVELS and not text.lower().strip().startswith(STEPS)
        if current is None or opens:
            current = (text, page, [])
            found.append(current)
        else:
            current[2].append(text)
    return [(title, page, " ".join(body).strip()) for title, page, body in found if " ".join(body).strip()]


def diverse(scored, per_document, k):
    """``scored``: (score, document, section) of one request."""
    taken, seen = [], Counter()
    for score, document, section in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if seen[document] < per_document:
            taken.append((document, section))
            seen[document] += 1
        if len(taken) == k:
            break
    return taken


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
