"""The patterns and word lists that text rules are stated in.

They read the same in Java's and RE2's dialect, so a query and its SQL use the same strings.
"""

WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
BYLINE = r"(?i)^(?:by)\s+[A-Z][A-Za-z.' -]+$"
FIXTURE = r"^(?:[A-Z0-9&.' -]+)\s+V(?:S\.?)?\s+(?:[A-Z0-9&.' -]+)$"
#: Blocks that are the paper's own furniture; all are anchored at the start.
NOISE = (
    r"^<!--.*-->$",
    r"(?i)^.*\bAdvocate\b.*\bEstablished October 1895\b.*$",
    r"(?i)^.*\bEstablished October 1895\b.*$",
    r"(?i)^\$\d+(?:\.\d{2})?\s+VAT Inclusive$",
    r"(?i)^Page\s+\d+$",
    r"^.*\b\d{1,2}:\d{2}$",
    r"(?i)^RUNOVER\b.*$",
    r"(?i)^\(?Cont['’]?d\b.*(?:page\s+\d+|next page).*\)?$",
    r"(?i)^.{1,50}\b(?:from|on)\s+(?:Front\s+)?Page\s+\d+$",
    r"(?i)^\(?See .*\bPage\s+\d+.*\)?$",
    r"(?i)^(?:ABOVE|BELOW|RIGHT|AT RIGHT|BELOW RIGHT)\b.*",
    r"^\((?:DB|JB)\)$",
    r"(?i)^(?:SCAN ME|SUBSCRIBE NOW\b.*|SEE MORE\b.*|VISIT US AT\b.*)$",
    r"(?i)^(?:Telephone|Contact|Email|Website):\s*.*$",
    r"(?i)^(?:https?://|www\.)\S+",
)
CAPTION = (
    r"(?i)^\(?(?:From left|From right|Pictured|Photo)\b",
    r"(?i)\((?:[^)]*/)?(?:BGIS|AP|Reuters|Photo[^)]*|Picture[^)]*)\)\s*$",
    r"(?i)\b(?:photo|picture)\s+(?:by|courtesy of)\b",
    r"(?i)\bPictured (?:here|from left|from right)\b",
)
CAPTION_VERB = r"(?i)\b(?:poses?|present(?:s|ed|ing)|accepts?|greeting|looking on|helping)\b"
LEGAL = (r"(?i)\bSUPREME COURT OF BARBADOS\b", r"(?i)\bNOTICE OF APPLICATION FOR DECLARATION OF OWNERSHIP\b", r"(?i)\bIN THE MATTER OF THE LAND \(TITLE PROCEEDINGS\) ACT\b", r"(?i)\bCLAIM NO\.\s*[A-Z0-9/-]+")
#: Names that place a text in the domain, and names (or a wire credit at the end) that place it outside.
LOCAL_NAMES = (
    "Barbados", "Barbadian", "Barbadians", "Bajan", "Bridgetown", "CARICOM", "Caribbean", "Christ Church",
    "Saint Michael", "St. Michael", "Saint Philip", "St. Philip", "Saint Peter", "St. Peter", "Saint James", "St. James",
    "Saint Lucy", "St. Lucy", "Saint George", "St. George", "Saint Thomas", "St. Thomas", "Saint Andrew", "St. Andrew",
    "Saint Joseph", "St. Joseph", "Saint John", "St. John", "UWI", "Cave Hill",
)
FOREIGN_NAMES = ("Israel", "Israeli", "Tunisia", "Tunisian", "Ukraine", "Ukrainian", "United States", "Washington", "New York", "London", "European Union", "Virgin Galactic")
LOCAL_TERMS = r"(?i)\b(?:" + "|".join(n.replace(".", r"\.") for n in LOCAL_NAMES) + r")\b"
FOREIGN_TERMS = r"(?i)\b(?:" + "|".join(FOREIGN_NAMES) + r")\b|\((?:AP|Reuters)\)\s*$"
#: Beginnings that scanners misread -> as printed; the first that fits holds.
PREFIXES = (("A s ", "As "), ("B arbados ", "Barbados "), ("C ricket ", "Cricket "), ("T he ", "The "), ("T wo ", "Two "), ("W e've ", "We've "), ("W ho ", "Who "))
#: Marks of a text that goes on elsewhere, and promotions to the end of a text.
CONTINUED = r"(?i)\s*\(Cont'd\s+(?:from|on)\s+(?:next\s+)?Page\s+\d+\.?\)"
PROMOTION = r"(?i)\s+SUBSCRIBE NOW\b.*$"
SENTENCE_END = r"(?<=[.!?])\s+"
AUDIO_TAG = r"<\|[^|]+\|>"
#: Typographic signs -> plain ones.
SIGNS = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", " - "), ("—", " - "), ("…", "..."), (" ", " "))
#: White space of any script.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
