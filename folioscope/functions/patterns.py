"""Patterns, phrase lists and thresholds that decide results.

Patterns run alike in Java's and RE2's engines: no look-around, ASCII classes.
"""

# Page chrome.
PRINT_TIMESTAMP = r"(?i)\b\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(:\d{2})?\s*[ap]\.?m\.?\b"
BARE_URL = r"(?i)https?://\S+"
PAGE_N_OF_M = r"(?i)\bpage\s+\d+\s+of\s+\d+\b"
SEPARATORS = r"[\s|·•\-–—,:;]+"
CHROME_MOST_CHARS = 140
CHROME_LEAST_RESIDUE = 8
CHROME_CATEGORIES = ("header", "footer", "pagenumber", "page_number")

# Document classes.
HEADING = r"^\s*\d+(\.\d+){0,3}\.?\s+\S"
LEGAL_NAMES = ("ex-10", "ex10", "agreement", "contract", "nda", "lease", "deed", "amendment", "addendum", "msa", "sow")
FINANCIAL_NAMES = ("10-k", "10k", "10-q", "10q", "20-f", "8-k", "annual", "financial", "balance", "income")

# Fiscal years in file names; the digit that may not come before or after is matched, and the year is group 2.
NAME_DATE = r"(^|[^0-9])((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([^0-9]|$)"
NAME_FY = r"(?i)\bfy[\s_-]?((?:19|20)\d{2}|\d{2})\b"
NAME_YEAR = r"(^|[^0-9])((?:19|20)\d{2})([^0-9]|$)"
YEAR_MIN, YEAR_MAX = 1990, 2099

# Prompt injection.
INJECTIONS = (
    "ignore all previous instructions", "ignore your previous instructions", "disregard the above", "disregard all previous",
    "system prompt", "you are now", "act as if", "jailbreak", "forget everything", "new instructions",
)

# Question complexity.
PAGE_REFERENCE = r"\bpage\s+\d+\b"
LOOKUP_OPENER = r"^(what is|what are|who is|who are|define|list|when|where|how many|how much)\b"
COMPLEX = (
    r"\b(compare|contrast|difference between|similarities|versus|vs\.?)\b",
    r"\b(analyze|analyse|evaluate|assess|critique|explain why|explain how)\b",
    r"\b(relationship between|impact of|implications of|trade-?offs?)\b",
    r"\b(pros and cons|advantages and disadvantages)\b",
    r"\b(summarize|summarise|overview of|breakdown of)\b",
)

# Numbers and labels in tables.
NUMBER_CELL = r"^\(?\$?\s*-?[\d,]+(?:\.\d+)?\s*\)?%?$"
NOISE_CELL = r"^[\s$%—–-]*$"
YEAR = r"\b(19|20)\d{2}\b"
UNITS_HINT = r"(?i)\b(in\s+(?:millions|thousands|billions)|per\s+share|except\s+per\s+share)\b"
UNIT_PHRASES = ("in millions", "in thousands", "in billions", "$ in millions", "$ in thousands")
AGGREGATE_LABEL = r"(?i)\b(total|consolidated|grand total|net (sales|revenue|income))\b"
PERCENT_SECTION = r"(?i)\b(percent|percentage|growth|rate)\b"
NUMERIC_CUES = (
    r"(?i)\b(growth|grew|increase|decrease|decline|change|delta|margin|ratio|percent|percentage|%|rate|sum|total|aggregate|average|mean|cagr|"
    r"compound|compare|comparison|versus|vs\.?|difference|differ|how much|how many|trend|year-over-year|yoy|revenue|sales|income|profit|loss|"
    r"expense|cost|ebitda|cash flow|assets|liabilities|equity)\b"
)
HAS_NUMBER = r"\b\d{4}\b|\$|\bQ[1-4]\b"
STATEMENT_ANCHORS = (
    "revenue", "net sales", "cost of", "operating", "net income", "total assets", "total liabilities", "cash", "gross", "expenses",
    "research and development", "income from operations",
)

# Gates on drafted text.
CITATION = r"\[[^\]]*\bp\.?\s*\d+[^\]]*\]|\[[^\]]+\]"
FIGURE = r"\$?\s*\d[\d,]*\.?\d*"
CONTENT_WORD = (
    r"(?i)\b(revenue|sales|income|profit|loss|margin|growth|increase|decrease|ratio|total|assets|liabilities|equity|cash|expense|cost|clause|"
    r"section|party|shall|agreement|liability|obligation|year|fiscal|quarter)\b"
)
SCAFFOLD = r"(?i)^\s*#{1,6}\s|^\s*_?Insufficient evidence"
INPUT_NEEDED = r"(?i)\[INPUT NEEDED:[^\]]*\]"
TOKEN = r"[A-Za-z][A-Za-z0-9&./'-]+"
STOPWORDS = (
    "the a an of to in on at by for and or but with as is are was were be been being this that these those it its their our your his her they "
    "them we i you he she which who whom whose from into over under between each any all some no not nor so than then there here will shall may "
    "might can could would should must have has had do does did a's per via"
).split()

# Instruments that may not be signed electronically, in order of precedence.
UNSIGNABLE = (
    (r"\bpromissory note\b", "negotiable_instrument"),
    (r"\bbill of exchange\b", "negotiable_instrument"),
    (r"\bcheque\b|\bcheck\b", "negotiable_instrument"),
    (r"\bnegotiable instrument\b", "negotiable_instrument"),
    (r"\bpower of attorney\b|\bgpa\b|\bspa\b", "power_of_attorney"),
    (r"\blast will\b|\btestament\b|\bcodicil\b|\bwill\b", "will"),
    (r"\btrust deed\b|\bdeed of trust\b", "trust"),
    (r"\bsale deed\b|\bconveyance\b|\bimmovable propert", "immovable_property"),
    (r"\bsale of land\b|\bproperty sale agreement\b", "immovable_property"),
)

# Parties.
OUR_SIDE = "client self company borrower buyer purchaser licensor employer applicant petitioner plaintiff claimant lender principal".split()
OTHER_SIDE = "opposing opponent adverse counterparty defendant respondent seller vendor guarantor licensee employee".split()
PARTY_SUFFIXES = (
    " private limited", " pvt ltd", " pvt limited", " ltd", " limited", " llp", " llc", " inc", " corp", " corporation", " co", " plc", " gmbh",
    " sa", " ag", " bv",
)

# Verbs by role.
WORKING = ("create_vault", "ingest", "ask", "draft", "run_workflow", "grids", "send_for_review")
GOVERNING = ("manage_members", "view_billing", "edit_playbooks", "publish_to_firm_brain")
ELEVATED = ("release_external", "manage_matter_team", "delete", "sign_certificate", "override_abstain", "run_sentinel")
ROLE_VERBS = {
    "managing_partner": WORKING + GOVERNING + ELEVATED,
    "senior_partner": WORKING + GOVERNING + ELEVATED,
    "partner": WORKING + GOVERNING + ELEVATED,
    "senior_associate": (*WORKING, "release_external", "manage_matter_team", "delete"),
    "associate": WORKING,
    "paralegal": WORKING,
    "assistant": WORKING,
    "client": ("ask",),
    "guest": (),
}

# Notifications.
EVENT_CATEGORY = {
    "review.awaiting": "review", "review.approved": "review", "review.changes_requested": "review", "review.released": "review",
    "review.escalation": "review", "matter.staffed": "matter", "answer.overridden": "governance",
}

#: Words that state a result, and phrases that state its absence, near the name of something asked for.
RESULT_WORDS = (
    "is", "was", "were", "are", "has", "have", "had", "totaled", "reached", "grew", "declined", "reported", "recorded", "found", "agreed", "states",
    "provides", "requires", "governed", "include", "includes", "cover", "covers", "specify", "specifies",
)
ABSENCE = (
    "could not", "couldn't", "unable to", "not available", "not found", "no data", "insufficient evidence", "cannot verify", "not in the vault", "not ingested",
)

#: The lines of a constitution that open an article, a part or a schedule, or say that an article is gone.
ARTICLE_LINE = r"^(\d+[A-Z]{0,3})\.\s+(.*)$"
ARTICLE_HEAD = r"^.{0,160}?[—–]"
ARTICLE_STUB = r"(?i)^\[([^\]]*)\]\s*((?:Rep\.|Omitted|Repealed|Rep\b).*)$"
ARTICLE_GONE = r"(?i)^\[?\s*(?:Art(?:icle)?\.?\s*)?(\d+[A-Z]{0,3})\b.*\b(?:omitted|repealed|rep\.)"
PART_LINE = r"(?i)^PART\s+([IVXLCDM]+[A-Z]?|\d+[A-Z]?)$"
SCHEDULE_LINE = r"(?i)^(?:THE\s+)?(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH|\d+(?:ST|ND|RD|TH)?)\s+SCHEDULE(?:\s*\[[^\]]*\])?$"

#: How a text begins that declines to answer.
DECLINES = (
    "abstain", "missing", "not found", "no ", "none", "i could not", "i cannot", "i can't", "could not verify", "cannot verify", "could not find",
    "cannot find", "unable to", "does not contain", "doesn't contain", "no such", "not present", "not applicable", "n/a",
)

# What opens and ends a list of names in a question, and the numbers of an answer.
COMPARING = r"(?i)\b(?:compare|versus|vs\.?|difference between|contrast)\b"
COMPARED_ENDS = r"(?i)\b(?:in|for|from|during|between|with|and their|revenue|margin|profit|sales|income|rate|growth|clause)\b"
FOR_EACH = r"(?i)\bfor each (?:of (?:the )?)?(?:the (?:following\b)?)?"
EACH_ENDS = r"(?i)\s*[.?!]\s*|\b(?:provide|give|state|list|show|tell)\b"
LIST_LABEL = r"^(?:\w+\s+)?\w+\s*:\s*"
LIST_SPLIT = r"\s*(?:,\s*(?:and\s+)?|(?:\s+and\s+))\s*"
ANSWER_NUMBER = r"-?\$?\(?\d[\d,]*(?:\.\d+)?\)?%?"
