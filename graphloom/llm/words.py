"""Words of a text: maximal runs of letters and digits after NFKC, without format characters, in lower case."""

from __future__ import annotations


def word_finder():
    """A function from text to its words. Made inside a task, so that nothing compiled has to travel."""
    import re
    import unicodedata

    import regex

    plain, full, hidden = re.compile("[a-z0-9]+"), regex.compile(r"[\p{L}\p{Nd}]+"), regex.compile(r"\p{Cf}+")

    def words(text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return plain.findall(text.lower())
        return full.findall(hidden.sub("", unicodedata.normalize("NFKC", text)).lower())

    return words
