"""Character classes as patterns that Java and RE2 read alike."""

#: White space as Python's str.isspace has it.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What is neither a word character nor white space.
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{WS}]"
SPACES = rf"[{WS}]+"
