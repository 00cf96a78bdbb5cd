"""Plain Python versions of what the operators compute."""


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else (1 - (total - 2 * lcs(a, b)) / total) * 100


def matches(left, right, threshold):
    found = {}
    for a in left:
        for b in right:
            total = len(a) + len(b)
            if 100 * (total - 2 * lcs(a, b)) <= (100 - threshold) * total:
                found[a, b] = ratio(a, b)
    return found
