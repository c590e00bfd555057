"""Words of the grammar language."""

# The names of single characters.
CHARACTERS = {
    "exclamation": "!", "double quote": '"', "hash": "#", "dollar": "$", "percent": "%", "ampersand": "&",
    "single quote": "'", "open paren": "(", "close paren": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less than": "<", "equals": "=",
    "greater than": ">", "question": "?", "at": "@", "open bracket": "[", "backslash": "\\", "close bracket": "]",
    "caret": "^", "underscore": "_", "backtick": "`", "open brace": "{", "pipe": "|", "close brace": "}",
    "tilde": "~", "space": " ", "tab": "\t", "newline": "\n", "carriage return": "\r", "null": "\0",
    "dot": ".", "dash": "-", "bang": "!",
}
# Other names of a character, and the name under which it is reported.
SAME_CHARACTER = {"dot": "period", "dash": "hyphen", "bang": "exclamation"}
# Classes of single bytes, as ranges.
CLASSES = {
    "letter": "AZ az", "digit": "09", "hex digit": "09 AF af", "whitespace": "   \t\t \n\n \r\r", "visible": "!~",
    "printable": " ~", "alphanumeric": "AZ az 09", "word character": "AZ az 09 __", "uppercase": "AZ", "lowercase": "az",
}
ANY = "any character"
# Plurals of classes.
PLURALS = {
    "letters": "letter", "digits": "digit", "alphanumerics": "alphanumeric", "any characters": ANY,
    "hex digits": "hex digit", "word characters": "word character",
}
# Words with a meaning of their own.
OPERATORS = (
    "one or more", "zero or more", "joined by", "any of", "none of", "use", "then", "or", "except", "optional", "to",
    "until", "isn't", "isnt", "extract", "including", "excluding", "lenient", "exactly", "between", "and", "one", "more",
    "of",
)


def class_bytes(name: str) -> frozenset[int]:
    ranges = (CLASSES[name] + " ") if name != "whitespace" else "   \t\t \n\n \r\r "
    return frozenset(b for k in range(0, len(ranges), 3) for b in range(ord(ranges[k]), ord(ranges[k + 1]) + 1))


def phrase(words: str) -> tuple[str, str] | None:
    """(kind, name) of a keyword of one or more words."""
    if words in OPERATORS:
        return "operator", "isn't" if words == "isnt" else words
    if words in CHARACTERS:
        return "character", SAME_CHARACTER.get(words, words)
    name = PLURALS.get(words, words)
    return ("class", name) if name in CLASSES or name == ANY else None
