"""What the tests of the operators share."""

import zlib

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, score double, digest string, node long, "
    "band int, value string, size int, n_lines int, kept boolean, lang_pred string"
)
CAT = "the cat sat on the mat and looked at the dog"


def held_out(key, parts, part):
    return zlib.crc32(str(key).encode()) % parts == part


def document(key, text, lang="en", source="web"):
    """A row whose extra columns have the names that operators use inside."""
    return (key, text, lang, source, None if text is None else len(text), "x", None, "y", 7, None, "z", 1, 2, None, "q")


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
