"""Plain Python versions that several tests share."""

from test_simhash import plain_components, plain_fingerprint
from test_substrings import plain


def plain_groups(texts):
    ids = sorted(texts)
    return plain_components(ids, [plain_fingerprint(texts[d]) for d in ids])


def plain_cut(texts, size):
    return {d: (kept, n, gone) for d, n, gone, kept in plain(sorted(texts.items()), size)}
