"""What the detectors look for. Fixed values, in the syntax that Java and RE2 share, and the spelling that Spark runs."""

INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
LETTERS = r"\p{L}+"
CYRILLIC = r"\p{IsCyrillic}"
LATIN = r"\p{IsLatin}"
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
HEX = r"[0-9a-fA-F]{32,}"
PURE_HEX = r"^[0-9a-fA-F]+$"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
TRAILING = r"(?m)[ \t]+$"
ASSIGNMENT = r"""(?i)(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*"?([A-Za-z0-9_\-+/=]{16,})"""
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
DIGITS = r"[0-9]{13,19}"
COMMENT = r"(?s)<!--(.*?)-->"
HIDDEN_ELEMENT = r"(?i)<[a-z][^<>]*(?:\shidden|display:\s*none|visibility:\s*hidden)[^<>]*>"
SCRIPT = r"(?is)<script[^<>]*>(.*?)</script>"
STYLE = r"(?is)<style[^<>]*>(.*?)</style>"
TAG = r"<[^<>]*>"

#: Letters that look like Latin ones, and those: Cyrillic, Greek, and full-width forms by their distance.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХЅІЈԌԚԜ" + "ανορΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))),
    "aeopcyxijshdqwABEKMHOPCTYXSIJGQW" + "avopABEZHIKMNOPTYX" + "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))),
)
#: Character references: numbers, and the names of what marks up or can't be seen.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos|nbsp|shy|zwnj|zwj|lrm|rlm);"
NAMED = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "shy": 173, "zwnj": 8204, "zwj": 8205, "lrm": 8206, "rlm": 8207}
#: Style rules that hide, with their selectors; selectors of one class or id; start tags with a class or an id.
HIDING_RULE = r"(?i)([^{}]*)\{[^{}]*(?:display\s*:\s*none|visibility\s*:\s*hidden)[^{}]*\}"
ONE_NAME = r"^(?:[a-zA-Z][a-zA-Z0-9]*)?[.#]-?[_a-zA-Z][_a-zA-Z0-9-]*$"
NAMED_TAG = r"""(?i)<[a-z][^<>]*\s(?:class|id)\s*=[^<>]*>"""
CLASS_VALUE = r"""(?i)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
ID_VALUE = r"""(?i)\sid\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
#: Carriers of bits: the zero-width space and non-joiner for 0 and 1, a blank and a tab at a line's end.
ZERO_WIDTH_BITS = r"[\x{200B}\x{200C}]"
LINE_END_BITS = r"(?m)[ \t]+$"

#: The same matches in a spelling that a backtracking engine finds in time that grows as the text: a run
#: is tried from its start only (or from where the last match ended), and never given back in part.
LINEAR = {
    BASE64: r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}",
    HEX: r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}+",
    TOKEN: r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+",
    TRAILING: r"(?md)(?<![ \t])[ \t]++$",
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    DIGITS: r"(?:\G|(?<![0-9]))[0-9]{13,19}+",
    HIDING_RULE: r"(?i)(?<![^{}])([^{}]*+)\{(?=[^{}]*+\})[^{}]*(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)[^{}]*\}",
    NAMED_TAG: r"(?i)<[a-z](?=[^<>]*+>)[^<>]*\s(?:class|id)\s*+=[^<>]*>",
    HIDDEN_ELEMENT: r"(?i)<[a-z](?=[^<>]*+>)[^<>]*(?:\shidden|display:\s*+none|visibility:\s*+hidden)[^<>]*>",
}
#: What a text must hold for a pattern to match at all: a cheap test before the search.
NEEDS = {EMAIL: "@", KEY_BLOCK: "PRIVATE KEY-----"}
#: What ends the last match: nothing after its last place can begin one, so the search stops there.
LAST = {COMMENT: r"(?s)^.*-->", SCRIPT: r"(?is)^.*</script>", STYLE: r"(?is)^.*</style>"}

#: Leading bytes of file types, in hex, by extension.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "47494638", "pdf": "255044462D", "zip": "504B0304", "exe": "4D5A", "gz": "1F8B08", "elf": "7F454C46"}
