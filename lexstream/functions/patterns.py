"""Fixed values shared by the column functions and the keyed folds.

The character sets, the abbreviation list and the placeholder shapes are fixed values: results
depend on them letter by letter.  Patterns are written so that Java (Spark) and the Python
``regex`` module read them alike; only the end-of-text anchor differs (``\\z`` and ``\\Z``).
"""

# Fixed values ---------------------------------------------------------------------------------
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
NO_SPACE_BEFORE = ",.!?;:%)]}、。，！？；：…）】》」』"
NO_SPACE_AFTER = "([{（【《「『"
TERMINAL = ".!?。！？…"
CLOSING = "\"'”’)]}）】》」』"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "pgs", "gs", "ts", "ths", "bs", "tp")
FULL_WIDTH = {".": "。", "!": "！", "?": "？"}
HYPHENS = "‐‑‒–—−"
# A placeholder is an opening mark, perhaps a word and its joint, a number and a closing mark.
PLACEHOLDER_PARTS = (("__", "term", "_", "__"), ("<", "term", "_", ">"), ("zx", "term", "", "zx"), ("ovt", "", "", "ovt"))
PLACEHOLDER_FORMATS = ("__TERM_%04d__", "OVT%04dOVT", "ZXTERM%04dZX")
# ----------------------------------------------------------------------------------------------


def char_class(chars: str) -> str:
    """Escape a set of characters for use between square brackets."""
    return "".join("\\" + c if c in "[]\\^-\"&" else c for c in chars)


SPACES = f"[{SPACE}]+"
WORD_TOKEN = f"[{WORD}]+(?:['’-][{WORD}]+)*|[^{WORD}{SPACE}]"
CHAR_TOKEN = f"[^{SPACE}]"
CLOSERS = char_class(CLOSING)
# In any case, with blanks allowed between the parts and any decimal digits as the number.
PLACEHOLDER = "(?i)(?:{})".format("|".join(
    f"[{SPACE}]*".join([x for x in (opening, word, joint) if x] + [r"\p{Nd}+", closing])
    for opening, word, joint, closing in PLACEHOLDER_PARTS
))


def sentence_end(end: str = r"\z") -> str:
    """Pattern of one sentence boundary with the marks and closers it absorbs."""
    sp = f"[{SPACE}]"
    abbreviation = "|".join(ABBREVIATIONS)
    dotted = r"[A-Za-z]\.[A-Za-z]\."
    initial = r"(?<=(?<!\p{L})\p{Lu}\.)"
    dot = (
        rf"\.(?={end}|{sp}|[{CLOSERS}])"
        rf"(?:(?={sp}*{end})"
        rf"|(?<!(?<!\p{{L}})(?i:{abbreviation})\.)"
        rf"(?:(?<={dotted})(?={sp}*\p{{Lu}})"
        rf"|(?<!{dotted})(?!{initial}{sp}*\p{{Lu}})))"
    )
    marks = char_class(TERMINAL)
    hard = char_class(TERMINAL.replace(".", ""))
    return rf"(?:[{hard}]|{dot})[{marks}]*[{CLOSERS}]*"


SENTENCE_END = sentence_end()
