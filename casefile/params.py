"""Default parameters of the operators. Every one can be replaced in a call."""

from __future__ import annotations

# Thresholds, lists and patterns that results depend on.
CASH_DEPOSIT_THRESHOLD = 50_000.0
HIGH_DEBIT_THRESHOLD = 500_000.0
HIGH_RISK, MEDIUM_RISK = 70, 40
MIN_TRANSACTION = 1000.0

WEBMAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "rediffmail.com", "zoho.com",
    "proton.me", "protonmail.com", "aol.com", "ymail.com", "live.com", "mail.com",
)
UPI_DOMAINS = ("phonepe.com", "google.com", "paytm.com", "cred.club", "razorpay.com", "npci.org.in", "bhimupi.org.in")
BANK_KEYWORDS = (
    "hdfc", "sbi", "icici", "axis bank", "kotak", "state bank", "bank of baroda", "canara bank", "netbanking",
    "account statement", "neft cr", "rtgs cr", "imps cr",
)
# What an amount of money looks like: a sign or a code before digits, or digits before a word. Digits are read from where they start.
CURRENCY_SIGNS, CURRENCY_CODES = "₹$€£", ("inr", "rs.", "rs", "usd", "eur", "gbp")
AMOUNT_WORDS = ("lakh", "lakhs", "crore", "crores", "lac", "lacs", "cr", "inr", "usd", "eur", "dollar", "dollars", "rupee", "rupees")


def money_pattern(signs: str = CURRENCY_SIGNS, codes: tuple[str, ...] = CURRENCY_CODES, words: tuple[str, ...] = AMOUNT_WORDS) -> str:
    """A pattern for texts that speak of an amount."""
    listed = lambda names: "|".join(n.replace(".", "\\.") for n in names)
    return rf"(?i)(?:[{signs}]|\b(?:{listed(codes)}))\s*[\d,]|(?<![\d,])[\d,]++(?:\.\d++)?\s*+(?:{listed(words)})"


CHAT_WATCHLIST = (
    ("cash", 70), ("commission", 60), ("bribe", 95), ("cut", 50), ("kickback", 95), ("hawala", 90),
    ("personal account", 80), ("gpay", 50), ("phonepe", 50), ("delete", 65), ("clear chat", 75),
    ("off the record", 85), ("dont email", 80), ("call me", 40), ("whatsapp only", 75), ("quote", 40),
    ("discount", 45), ("margin", 45), ("tender", 50), ("l1", 60), ("competitor", 55), ("inside info", 90), ("gift", 60),
)
VOICE_INTENTS = (
    ("Collusion", (("kickback", 95), ("commission", 65), ("cut", 50), ("bribe", 95), ("cash payment", 85), ("hawala", 90), ("off the record", 80), ("secret deal", 85), ("inside info", 90), ("win the tender", 75))),
    ("Concealment", (("dont email", 85), ("delete the message", 85), ("burn this", 90), ("dont tell anyone", 80), ("keep it quiet", 75), ("call on personal phone", 75), ("no paper trail", 90))),
    ("Price Negotiation", (("quote", 40), ("discount", 45), ("margin", 45), ("l1 price", 65), ("lower the bid", 60), ("rates", 35))),
    ("Pressure", (("cancel contract", 70), ("blacklist", 75), ("do as i say", 80), ("last chance", 65))),
    ("Procurement", (("rfq", 40), ("vendor", 30), ("supplier", 30), ("specification", 35), ("po number", 50), ("purchase order", 45))),
)
SCAN_HIGH = ("password", "credentials", "secret", "private_key", "id_rsa", "kickback", "bribe", "shadow", "offshore", "unauthorized", "exploit", "backdoor")
SCAN_MEDIUM = ("salary", "payroll", "invoice", "ledger", "confidential", "nda", "audit", "wire_transfer", "p&l")
LEGAL_SUFFIXES = (
    r"\bpvt\.?\s*ltd\.?\b", r"\bltd\.?\b", r"\bllp\b", r"\binc\.?\b", r"\bcorp\.?\b", r"\benterprises?\b",
    r"\bsolutions?\b", r"\bservices?\b", r"\btechnologies?\b", r"\bindia\b",
)
SOFTWARE_PENALTIES = (
    ("photoshop", 35), ("canva", 30), ("gimp", 35), ("pixelmator", 30), ("snapseed", 30), ("ilovepdf", 25),
    ("smallpdf", 25), ("sejda", 25), ("pdf24", 15), ("sodapdf", 15), ("pdf candy", 25),
)

# Fixed values of name extraction: what a rule's names are (category, role, confidence), titles, words of kin, speech and firms, given names, and what is no name.
HONORIFICS = ("Shri", "Smt", "Mr.", "Mrs.", "Ms.", "Dr.", "Thiru", "Tmt", "Selvi", "Er.", "Adv.", "Prof.")
NAME_RULES = (
    ("PERSON", "Identified Individual", 0.90), ("PERSON", "Patronymic Name", 0.88), ("KINSHIP", "Kinship / Associated Person", 0.92), ("ORGANIZATION", "Commercial Counterparty", 0.95),
    ("CONVERSATION", "Directly Mentioned Party", 0.85), ("PARTNER", "Contract Signatory", 0.95), ("PERSON", "Identified Indian Name", 0.80), ("DIGITAL_ID", "Financial Identifier", 0.95),
    ("DIGITAL_ID", "Contact Identifier", 0.90),
)
RAISED, RAISED_HIGH = ("KINSHIP", "CONVERSATION", "DIGITAL_ID"), ("KINSHIP", "CONVERSATION")
RAISED_DOCUMENT = ("PARTNER", "RELATED_PARTY")
PERSON_CONFIDENCE = 0.95
SPEAKER, CHAT_PARTNER = ("SPEAKER", "Recorded Speaker", 75, "ent_spk_"), ("CHAT_PARTNER", "Conversation Partner", 80, "ent_chat_")
AUTHOR, COMPANY = ("PERSON", "Author", 0.88), ("COMPANY", "Corporate Entity", 0.85)
LISTED_FILE_ENDS = ("pdf", "docx", "doc", "xlsx", "xls", "csv", "txt", "json", "png", "jpg", "jpeg", "wav", "mp3")
SPEAKER_BRACKETS, NO_SPEAKER = r"\(([^)]+)\)", r"(?i)^speaker(?: .*|\d*)$"
SHORT_TITLES = ("Shri", "Smt", "Mr.", "Mrs.")
TITLES = ("M/s", "M/s.", "Messrs", "Messrs.", *HONORIFICS)
PERSON_STARTS, NAME_ENDS = ("aged", "resident", "son", "wife", "w/o", "s/o"), ("for", "and", "entered")
PARTY_STARTS, PARTY_BRACKETS = ("aged", "resident", "son", "wife"), ("aadhar", "hereinafter")
LEAD_INS = ("called regarding", "regarding", "about", "with", "for", "at", "spoke to", "talk to")
FIRM_LEADS = ("Also", "The", "This", "Whereas", "Where", "Messrs", "M/s", "M/s.", "Called regarding", "Regarding", "For", "About", "With")
SPEECH_LEADS = ("about", "regarding")
KIN_WORDS = (
    "wife of", "w/o of", "w/o", "husband of", "son of", "s/o of", "s/o", "daughter of", "d/o of", "d/o", "father of", "mother of", "spouse of",
    "nominee is", "nominee",
)
KIN_ENDS = ("Spouse", "Nominee", "Wife", "Son", "Daughter", "Father", "Mother")
SPEECH_WORDS = ("talk to", "spoke to", "speak to", "tell", "told", "ask", "asked", "give to", "call", "called", "meet with", "met with", "paid to", "pay to", "send to", "sent to", "transfer to")
FIRM_WORDS = (
    "Engineers", "Enterprises", "Traders", "Associates", "Solutions", "Industries", "Agency", "LLP", "Ltd", "Limited", "Private Limited", "Pvt Ltd", "Corp",
    "Holdings", "Technologies", "Infra",
)
UPI_HANDLES = ("okaxis", "okhdfcbank", "oksbi", "icici", "paytm", "ybl", "axl", "ibl", "apl", "upi")
FILE_ENDS = ("pdf", "docx", "doc", "xlsx", "xls", "csv", "txt", "json", "png", "jpg", "jpeg", "wav", "mp3", "eml", "msg")
PLACE_WORDS = ("ROAD", "STREET", "NAGAR", "AVENUE", "LANE", "COLONY", "CROSS STREET", "MAIN ROAD", "RELATION SUM", "NET PAY")
GIVEN_NAMES = (
    "venkat", "venkatesan", "dhanasekaran", "maharajan", "balamurugan", "senthamilkannan", "pasupathy", "selvi", "monisha", "rajan", "raj", "suresh", "ramesh",
    "karthik", "rajesh", "sharma", "verma", "gupta", "joseph", "remigius", "silviya", "murugan", "kumar", "balu", "lakshmi", "priya", "anand", "sundar", "nathan",
    "swaminathan", "palani", "shanthi", "chidambaram", "natarajan", "dhasarathan", "vani", "subramanian", "krishnan", "saravanan", "senthil", "iyer", "iyengar",
    "nair", "reddy", "rao", "singh", "patel", "mehta", "shah", "bose", "das", "mishra", "pandey", "tiwari", "tripathi", "agarwal", "bansal", "jain", "choudhury",
)
NO_NAMES = (
    "WHATSAPP", "TELEGRAM", "SIGNAL", "OUTLOOK", "GMAIL", "TEAMS", "ZOOM", "MEETING", "CALL", "RECORDING", "AUDIO", "ATTACHMENT", "IMAGE", "VIDEO", "DOCUMENT",
    "FILE", "FOLDER", "SCAN", "DOWNLOAD", "UPLOAD", "MESSAGE", "CHAT", "TRANSCRIPT", "TODAY", "TOMORROW", "YESTERDAY", "MORNING", "EVENING", "AFTERNOON", "NIGHT",
    "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY", "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
    "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER", "AGREED", "RECEIVED", "APPROVED", "REJECTED", "PENDING", "CONFIRMED", "THANK YOU", "THANKS", "PLEASE", "KINDLY",
    "REGARDS", "DEAR", "HELLO", "HI", "HEY", "OKAY", "YES", "NO", "FINE", "DONE", "PAYMENT", "INVOICE", "BILL", "RECEIPT", "VOUCHER", "STATEMENT", "ACCOUNT",
    "AMOUNT", "BALANCE", "CREDIT", "DEBIT", "CASH", "TRANSFER", "RUPEES", "GOVERNMENT OF INDIA", "INDIA NON JUDICIAL", "TAMIL NADU", "TAMIL", "NADU",
    "NON JUDICIAL", "STAMP VENDOR", "PARTNERSHIP DEED", "DEED OF PARTNERSHIP", "FIRST PARTY", "SECOND PARTY", "THIRD PARTY", "PAGE", "SR.NO", "SR NO",
    "PROFIT SHARING", "REGISTERED", "TALUK", "DISTRICT", "AADHAR NO", "PAN NUMBER", "DATE", "TOTAL", "SCHEDULE", "EMPLOYEE", "NOMINEE", "NOMINEE SCHEDULE",
    "EMPLOYEE SCHEDULE", "SANITIZED", "REPORT", "AGREEMENT", "CONTRACT", "SUMMARY", "EXTRACT", "INTERIM", "DRAFT", "FINAL", "AUDIT", "DEVICE", "LOG", "SYSTEM",
)
