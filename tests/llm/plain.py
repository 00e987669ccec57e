"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def normal_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def shingles(text, width=5):
    words = spaced_words(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_components(docs, similarity=75):
    """{id: (set size, smallest id of the component)}"""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(text, items, width=13):
    """(words, hit words, items hit)"""
    words = normal_words(text)
    hit, named = set(), set()
    for item, item_text in items:
        own = normal_words(item_text)
        size = min(len(own), width)
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                named.add(item)
    return len(words), len(hit), {n for n in named if n is not None}


def odd_rows():
    """Nulls in all columns, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}" for i in range(9000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here and there again", "en", "a", 3),
        (4, "same words here and there again", None, "b", 3), (4, "same words here and there again", None, "b", 3),
        (None, "same words here and there again", "en", None, None), (None, "no id", "en", "a", 5),
        (7, long_text, "en", "a", 1), (8, long_text + " tail", "en", "a", 1), (9, "  \n\t ", "en", "a", 1),
        (10, "Émile ÉTÉ naïve", "fr", "a", 1)]
