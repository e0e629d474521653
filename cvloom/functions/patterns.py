"""Patterns of the extraction rules, in Java's dialect. They decide which results are right."""

EMAIL = r"(?<![.\w\p{L}\p{N}])[a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,10}(?=[^a-zA-Z0-9]|$)"
PHONE = r"(?:\+\d{1,3}[\s\-]?)?(?:\(\d{1,4}\)[\s\-]?)?\d[\d\s\-.]{6,17}\d"
CONTACT_LABEL = (
    r"(?i)^\s*(?:phone|mobile|cell|tel|telephone|email|e[\s\-]?mail|linkedin|github|address|location|website|url|portfolio|"
    r"contact|dob|date\s+of\s+birth|nationality|gender)\s*[:\-]?\s*"
)
URL_START = r"(?i)https?://|www\."

LINKEDIN_URL = r"(?i)\b(?:https?://)?(?:[a-zA-Z0-9_\-]+\.)?linkedin\.com/in/([a-zA-Z0-9_\-%]+)(?:/[a-zA-Z0-9_\-%]*)?"
LINKEDIN_LABEL = r"(?i)linkedin(?:\s+profile|\s+url)?\s*[:\-–—]\s*"
LINKEDIN_LABELLED = LINKEDIN_LABEL + r"((?:https?://)?(?:[a-zA-Z0-9_\-]+\.)?linkedin\.com/in/([a-zA-Z0-9_\-%]+))"
GITHUB_URL = r"(?i)\b(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9][a-zA-Z0-9_\-]{0,38})(?:\b|/|\z)"
GITHUB_LABELLED = r"(?i)\bgithub(?:\s+profile|\s+url)?\s*[:\-–—]\s*(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9_\-]+)"
URL_TAIL = r"[.,;:)>\]\s/]+$"

SKILL_LABEL = r"(?md)^\s*[A-Za-z &/()]+:\s*"
SKILL_SEPARATORS = r"[,|•\-–—►▪✓*]"

_BARE = r"(?<![A-Za-z])", r"(?![A-Za-z])"
_DEGREES = [
    r"Doctor\s+of\s+Philosophy",
    "Ph\\.?D\\.?",
    r"Master\s+of\s+(?:Technology|Engineering|Science|Arts|Commerce|Business\s+Administration|Computer\s+Applications|Computer\s+Science)",
    "M\\.?Tech\\.?", "M\\.?E\\.?", "M\\.?Sc\\.?", "M\\.?C\\.?A\\.?", "M\\.?B\\.?A\\.?", "M\\.?S\\.?",
    r"Bachelor\s+of\s+(?:Technology|Engineering|Science|Arts|Commerce|Business\s+Administration|Computer\s+Applications|Computer\s+Science|Information\s+Technology)",
    "B\\.?Tech\\.?", "B\\.?E\\.?", "B\\.?Sc\\.?", "B\\.?C\\.?A\\.?", "B\\.?B\\.?A\\.?", "B\\.?C\\.?S\\.?", "B\\.?Com\\.?", "B\\.?A\\.?", "B\\.?S\\.?",
    r"Diploma(?:\s+in\s+\w[\w\s]*)?",
    r"Higher\s+Secondary(?:\s+Certificate)?",
    "H\\.?S\\.?C\\.?", "S\\.?S\\.?C\\.?",
    r"Secondary\s+School\s+Certificate",
    r"10\+?2",
    r"12th(?:\s+(?:Grade|Standard|Class))?",
    r"10th(?:\s+(?:Grade|Standard|Class))?",
    r"Class\s+(?:XII|X)",
    r"Grade\s+(?:XII|XI|X)",
]


def _bounded(d: str) -> str:
    """Abbreviations made of letters and dots stand alone: no letter beside them."""
    return _BARE[0] + d + _BARE[1] if "\\.?" in d else d


DEGREE = "(?i)(?:" + "|".join(map(_bounded, _DEGREES)) + ")"
FIELD_AFTER = r"(?i)^(?:in\b\s+|\s*[\-–(,]\s*)([A-Za-z][A-Za-z\s&/\-.]{2,50})"
FIELD_ANYWHERE = r"(?i)\bin\s+([A-Za-z][A-Za-z\s&/\-.]{2,50})"
INSTITUTION = r"(?i)\b(?:university|universities|institute|institution|college|school|academy|polytechnic|faculty|campus|vidyalaya|vidyapeeth|mahavidyalaya|iit|nit|iiit|bits|iim|mit|deemed)\b"
_MON3 = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?\\s+"
EDU_DATES = rf"(?i)(?:{_MON3})?\d{{4}}\s*[-–—to]+\s*(?:{_MON3})?(?:\d{{4}}|Present|Ongoing|Current)"
EDU_YEAR = r"\b(?:19[5-9]\d|20[0-3]\d)\b"
EDU_DATE_ONLY = rf"(?i)^\s*(?:{_MON3})?\d{{4}}\s*(?:[-–—to]\s*(?:{_MON3})?(?:\d{{4}}|Present|Ongoing|Current))?\s*$"
_N = r"\d+(?:\.\d+)?"
GRADE = rf"(?i)(?:CGPA\s*[:\-]?\s*{_N}(?:\s*/\s*{_N})?|GPA\s*[:\-]?\s*{_N}(?:\s*/\s*{_N})?|Percentage\s*[:\-]?\s*{_N}\s*%?|Score\s*[:\-]?\s*{_N}\s*%?|Marks\s*[:\-]?\s*{_N}\s*%?|{_N}\s*%)"
EDU_SKIP = r"(?i)^\s*(?:CGPA|GPA|Percentage|Score|Marks|Grade|Location|City|Summary|Profile|Skills|Experience|Projects|Achievements|Certifications|Languages|Interests|References|Contact|Phone|Email|Mobile|LinkedIn|GitHub|Address)\b"
EDU_SEPARATOR = r"[,|—–\-]{1,2}"

_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\.?\\s+"
EXP_DATES = (
    rf"(?im)(?:(?:{_MONTH})?\d{{4}}\s*[-–—to/]+\s*(?:{_MONTH})?(?:\d{{4}}|Present|Current|Ongoing|Now))"
    r"|(?:\d{1,2}/\d{4}\s*[-–—]+\s*(?:\d{1,2}/\d{4}|Present|Current))|(?:^|\b)(?:Present|Current)(?:\b|$)"
)
EXP_DATE_ONLY = rf"(?i)^\s*(?:(?:{_MONTH})?\d{{4}}(?:\s*[-–—to]+\s*(?:{_MONTH})?(?:\d{{4}}|Present|Current|Ongoing|Now))?|\d{{1,2}}/\d{{4}}\s*[-–—]+\s*(?:\d{{1,2}}/\d{{4}}|Present|Current))\s*$"
BULLET = r"^\s*[-•*▪●►◦]\s+"
EXP_SEPARATOR = r"\s*[|—–]\s*"
COMPANY = r"(?i)\b(?:technologies|technology|solutions|systems|software|services|consulting|consultancy|corporation|corp|incorporated|inc|limited|ltd|pvt|llc|labs|laboratory|studio|group|ventures|enterprises|industries|international|global|digital|networks|analytics|university|institute|research|lab)\b"
LOCATION = r"(?i)\b(?:mumbai|delhi|bangalore|bengaluru|hyderabad|chennai|pune|kolkata|ahmedabad|jaipur|surat|lucknow|kanpur|nagpur|indore|bhopal|new\s+york|los\s+angeles|san\s+francisco|chicago|seattle|boston|london|paris|berlin|toronto|sydney|singapore|remote|india|usa|uk|united\s+states|united\s+kingdom)\b"
DEGREE_GUARD = r"(?i)(?:b\.?tech|b\.?e\.|m\.?tech|mba|bca|mca|b\.?sc|m\.?sc|phd|ph\.d|bachelor|master|doctor|diploma|hsc|ssc|10th|12th)"
