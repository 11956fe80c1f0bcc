"""Words of a text as they are compared across spellings, layouts and markup."""

from __future__ import annotations

import html
import re
import unicodedata

# Attributes as HTML and XML write them; a tag may have any number of them, of any length. What has no such form, as in
# "a <b, c> d", is text. No part is tried in two ways, so that a text is gone through once.
_ATTRIBUTE = r"""[A-Za-z_:@*#\[(][\w:@*#\[\]()-]*+(?:\.[\w-]++)*+(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s<>"']++))?+"""
_REST = rf"""(?>(?:\s++|(?<=["']))(?:{_ATTRIBUTE}|/(?!>)))*+\s*+/?+>"""
_INLINE_TAG = re.compile(rf"</?+(?:a|b|i|u|s|em|strong|span|code|tt|sub|sup|mark|small|font){_REST}", re.IGNORECASE)
# Also addresses in angle brackets, and declarations.
TAG = re.compile(rf"</?+[A-Za-z][\w:.-]*+{_REST}|<[A-Za-z][\w+.-]*+:[^\s<>]*+>|<[^\s<>@]++@[^\s<>]++>|<[!?][A-Za-z][^<>]*+>")
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
# A hyphen between word characters, also with a line break (and a quote mark) behind it, holds one word together; so does an
# apostrophe. What stands before is looked at once one is found.
_JOINED = re.compile(r"[-‐‑]++(?:[ \t]*+\r?+\n[ \t>|]*+)?+(?=\w)|['’ʼ](?=\w)")
_ASCII = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff]")


def visible(text: str) -> str:
    """Without characters that have no width."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


def without_tags(text: str) -> str:
    """Without markup of any length; tags inside words leave no gap, others do."""
    ended = text.rfind("-->")  # nothing is looked for behind the last end of a comment
    if ended >= 0:
        text = _COMMENT.sub(" ", text[: ended + 3]) + text[ended + 3 :]
    return TAG.sub(" ", _INLINE_TAG.sub("", text))


def words(text: str | None) -> list[str]:
    """Lower-case words; case, punctuation, markup, line layout, invisible characters and Unicode form don't matter."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = without_tags(text)
    text = text.casefold()

    def join(found: re.Match) -> str:
        before = text[found.start() - 1 : found.start()]
        return "" if before.isalnum() or before == "_" else found[0]

    joined = _JOINED.sub(join, text)
    return joined.translate(_ASCII).split() if joined.isascii() else _WORD.findall(joined)
