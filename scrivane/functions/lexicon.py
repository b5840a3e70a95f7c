"""Lists and patterns of the extraction functions. All are fixed values; the skill dictionary is a parameter."""

#: Section headers: a line that contains one of these opens or closes a section. Each is matched without regard to case.
SECTION_HEADERS = {
    "skills": r"skills?|technical\s+skills?|key\s+skills?|core\s+competencies?|competencies?|expertise|proficiencies?|areas\s+of\s+expertise|tools?\s*(?:and|&)?\s*technologies?|rececai\s+sks|reccar\s+seus",
    "education": r"education(?:al)?\s*(?:background|qualification|detail)?|academic(?:\s+background)?|qualifications?|degrees?|epucanon|edueation",
    "experience": r"(?:work|professional|employment|job|career)\s*(?:experience|history|background)",
    "certifications": r"certifications?|certificates?|licensures?|credentials?|professional\s+certifications?|certifications?\s*&\s*courses?",
    "languages": r"languages?|linguistic\s+(?:skills?|abilities?)|language\s+(?:skills?|proficiency)|vancuaces",
    "soft_skills": r"soft\s+skills?|interests?|hobbies?|career\s+objective|activities",
    "projects": r"projects?|key\s+projects?|notable\s+projects?",
    "summary": r"summary|professional\s+summary|objective|career\s+objective|profile|about\s+me|personal\s+statement",
}

#: Display names that the general rule would not give.
CANONICAL_SKILLS = {
    "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "nodejs": "Node.js", "node.js": "Node.js", "reactjs": "React", "react.js": "React", "react": "React",
    "sklearn": "Scikit-Learn", "scikit-learn": "Scikit-Learn", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "golang": "Go", "go": "Go", "c++": "C++", "c#": "C#", "aws": "AWS", "gcp": "GCP", "sql": "SQL", "nosql": "NoSQL",
    "ci/cd": "CI/CD", "nlp": "NLP", "ai": "Artificial Intelligence", "ml": "Machine Learning", "ui/ux": "UI/UX", "ui": "UI Design", "ux": "UX Design", "git": "Git", "github": "GitHub", "gitlab": "GitLab", "html": "HTML", "css": "CSS",
    "php": "PHP", "r": "R", "c": "C", "sap": "SAP", "crm": "CRM", "seo": "SEO", "sem": "SEM", "rest api": "REST API",
}

#: Words that a line with a person's name does not contain.
NOT_IN_NAMES = (
    "resume", "curriculum", "vitae", "profile", "address", "objective", "summary", "experience", "education", "skills", "http", "www", "@", "phone", "email", "mobile", "tel", "contact", "developer", "engineer", "designer", "creator",
    "kathmandu", "nepal", "maitidevi", "street", "road", "avenue", "city", "state", "linkedin", "github", "python", "javascript", "react", "html", "css", "node", "java",
)

#: Cities that give a location, with the spellings that scanning makes of one of them.
CITIES = "Kathmandu|Katenandta|Karthrrendu|Kathrresdu|Katesandu|Lalitpur|Bhaktapur|Pokhara|Biratnagar|Chitwan|Nepal|New York|London|San Francisco|Sydney|Toronto|Tokyo|Berlin|Paris|Delhi|Bangalore|Mumbai|Dubai|Singapore"
NOT_IN_LOCATION_LINES = ("college", "university", "school", "degree", "bachelor", "master", "bsc", "b.sc", "student", "faculty")

DEGREES = (
    r"\b(?:Bachelor(?:\'s)?)\s*(?:\([^\)]*\))?\s*(?:of|in|with)?\s*[^\n]*",
    r"\b(?:BSc\s*(?:\(Hons\))?|B\.Sc\.?)\s*(?:in|of|with)?\s*[^\n]*",
    r"\b(?:B\.Tech|BTech|B\.E\.?|BCA|BIT)\b[^\n]*",
    r"\b(?:Master(?:\'s)?|Masters)\s*(?:of|in|with)\s*[^\n]+",
    r"\b(?:MSc|M\.Sc\.?|M\.Tech|MTech|MCA|MBA)\b[^\n]*",
    r"\b(?:Ph\.?D\.?|Doctor(?:ate)?)\b[^\n]*",
    r"\b(?:Associate(?:\'s)?|Diploma|Certificate)\s+(?:in|of)\s+[^\n]+",
    r"\b(?:High School|Secondary|SSC|HSC|10\+2|Intermediate)\b[^\n]*",
    r"\b(?:NCEA\s+Level\s+\d+)\b[^\n]*",
    r"\bGraduated\s+with\s+NCEA[^\n]*",
)
DEGREE_ANCHORS = r"^\s*(?:bachelor|b\.?s\.?c?|b\.?e\.?|b\.?tech|b\.?a\.?|bsc|bca|bit|be|bs|bcom|master|m\.?s\.?c?|m\.?e\.?|m\.?tech|mba|mca|msc|ms|ph\.?d|doctor(?:ate)?|associate|diploma|certificate|high school|secondary|ssc|hsc|10\+2|intermediate|ncea|graduated with ncea)"
#: What is cut off a degree, in order: pattern and what takes its place.
DEGREE_TRIMS = (
    (r"[\s,]*[\w.+\-]+@.*$", ""),
    (r"[\s,]*@.*$", ""),
    (r"^B?Sc\s+Ptora\)\s*", "BSc (Hons) "),
    (r"[\s,|-]+[a-zA-Z]$", ""),
    (r"[\s,|-]+$", ""),
)
NCEA_SCHOOL = r"(?:at|,)\s*([A-Z][a-zA-Z\s]+(?:College|School|Academy|High School)[\w\s,]*)"
NOT_IN_DEGREES = (
    "kathmandu", "nepal", "maitidevi", "lalitpur", "pokhara", "new york", "london", "australia", "street", "lane", "avenue", "managed", "developed", "methods", "maintair", "maintained", "provided", "responsible", "lorem", "ipsum", "dolor", "consectetur",
)
UNIVERSITY = (
    r"\b(?:(?:in\s+partnership\s+with\s+)?([A-Z][a-zA-Z\s\&\.\-]{2,40}\s+(?:University|College|Institute(?:\s+of\s+Technology)?|School|Academy|Polytechnic|Campus)(?:\s*\([^\)]+\))?(?:[\w\s,]*))|"
    r"(?:MIT|Stanford(?:\s+University)?|Harvard(?:\s+University)?|Oxford(?:\s+University)?|Cambridge(?:\s+University)?|Caltech|NYU|UCLA|CMU|UC\s+Berkeley|IIT\s+[A-Z][a-z]+|Columbia\s+University|Yale(?:\s+University)?|Princeton(?:\s+University)?))\b"
)
#: What is cut off a school's name, in order, and spellings to repair (case counts).
UNIVERSITY_TRIMS = (
    (r"(?i)\s+[\w.+\-]+@[\w.\-]+\.[a-zA-Z]{2,6}.*$", ""),
    (r"(?i)^(?:in\s+partnership\s+with|partnenthip\s+with|partnership\s+with|affiliated\s+with|in\s+affiliation\s+with|and\s+|at\s+)\s*", ""),
    (
        r"(?i)^(?:with\s+)?(?:Artificial\s+Intelligence|Computer\s+Science|Software\s+Engineering|Data\s+Science|Information\s+Technology|Business\s+Administration|Mechanical\s+Engineering|Electrical\s+Engineering|Civil\s+Engineering)\s*",
        "",
    ),
    (r"(?i)\s+(?:Current|Semester|GPA|\d{4}).*$", ""),
    (r"\bBOUL\b", "(BCU)"),
)
UNIVERSITY_SPELLINGS = (
    (r"\bOty\b", "City"),
    (r"\bSurman\b|\bburnmay\b", "Sunway"),
    (r"\bKarthrrendu\b|\bKathrresdu\b|\bKatenandta\b", "Kathmandu"),
    (r"\bGemninghan\b|\bBerningharn\b", "Birmingham"),
)
GENERIC_SCHOOLS = ("college", "university", "institute", "school", "academy", "campus", "polytechnic")

JOB_TITLE = (
    r"\b(?:Senior|Junior|Lead|Principal|Chief|Head|Director|VP|Vice\s+President|Manager|Supervisor|Coordinator|Executive|Associate|Assistant|Freelance|Staff|Entry.Level)?\s*"
    r"(?:Software|Data|Machine\s+Learning|AI|ML|AI/ML|Business|Financial|Marketing|Sales|HR|Human\s+Resources|Operations|Product|Project|Program|Account|Systems?|Network|Cloud|DevOps|Full.?Stack|Front.?End|Back.?End|"
    r"Graphic|UI|UX|UI/UX|Web|Visual|Creative|Digital|Brand|Industrial|Game|Interior|QA|Quality|Research|Analytics?|Database|Security|IT|Content|Copy|Event|Social\s+Media)?\s*"
    r"(?:Engineer|Developer|Analyst|Scientist|Architect|Manager|Consultant|Specialist|Administrator|Officer|Advisor|Designer|Director|Coordinator|Coordination|Executive|Lead|Intern|"
    r"Technician|Strategist|Producer|Writer|Editor|Representative|Creator|Assistant|Supervisor|Instructor|Teacher|Accountant|Auditor|Doctor|Nurse|Chef|Cook|Design|Promotion)\b"
)
MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
SINGLE_DATE = rf"(?:{MONTHS}\s*[\.,\'-]?\s*\d{{2,4}}|\d{{1,2}}/\d{{2,4}}|\b(?:19|20)\d{{2}}\b)"
PERIOD = rf"({SINGLE_DATE}\s*(?:[\-–—/~]+|\s+to\s+)\s*(?:{SINGLE_DATE}|(?:Present|Current|Ongoing|Now|Till\s*Date|To\s*Date)))"
ACTION_VERBS = (
    "created", "developed", "managed", "led", "assisted", "designed", "built", "provided", "maintained", "responsible", "worked", "organized",
    "collaborated", "implemented", "coordinated", "directed", "supervised", "analyzed", "achieved", "conducted", "established", "spearheaded",
    "oversaw", "supported", "resolved", "executed", "participated", "handled", "performed",
)
ADDRESS_WORDS = frozenset((
    "street", "lane", "road", "rd", "st", "ave", "avenue", "drive", "blvd", "boulevard", "way", "highway", "pkwy", "box", "po",
))
SECTION_WORDS = frozenset(("experience", "work experience", "employment history", "professional experience", "skills", "technical skills", "education", "profile", "contact", "summary", "references", "certifications", "projects"))
ACADEMIC_WORDS = frozenset((
    "graduated", "graduate", "graduation", "degree", "bachelor", "master", "phd", "diploma", "certificate", "certification", "secondary", "ncea",
    "gpa", "course", "courses", "curriculum", "syllabus", "subject", "geography", "history", "english", "science", "math", "mathematics", "physics",
    "chemistry", "biology", "student", "class", "grade", "merit", "excellence", "endorsement", "endorsements", "honors", "honours", "academic",
    "school", "college", "university", "qualification", "studies",
))
STRONG_ACADEMIC_WORDS = frozenset((
    "ncea", "gpa", "graduated", "degree", "diploma", "bachelor", "master", "endorsement", "excellence", "merit",
))
YEAR = r"\b(?:19|20)\d{2}\b"
AT_COMPANY = r"^([A-Z][^@\d]{2,45}?)\s+(?:at|@)\s+([A-Z][^@\d]{2,50})(?:\s*[(\[]?(.*?)[)\]]?)?$"
SCAN_NOISE = (r"\bAf,\b", r"\bSD\b", r"\bTT\b", r"\bGINS\b", r"\bDein\b", r"\bDain\b", r"\bmarwerIns\b", r"\brecunicat\b", r"\bwncuaces\b", r"\bAvml\b", r"\bSrophic\b", r"\burxcesen\b")
FRAGMENT_STARTS = r"(?:and\b|to\b|the\b|a\b|an\b|in\b|of\b|for\b|with\b|on\b|aim\b|by\b|or\b|that\b|this\b|where\b|while\b|which\b|who\b|how\b|when\b|seeking\b|looking\b|passionate)"

CERTIFICATES = (
    r"\b(?:Machine\s+Learning\s+with\s+Python|Introduction\s+to\s+AI|Responsive\s+Web\s+Design|UI/UX\s+Design(?:\s+Basics)?|Git\s*&\s*GitHub(?:\s+Fundamentals)?|[A-Z][a-zA-Z0-9\s\&\.\-]{3,40}\s*-\s*(?:Coursera|Udemy|freeCodeCamp|edX|IBM|Google|Microsoft))\b[^\n]*",
    r"\b(?:Certified|Certificate(?:\s+in)?|Certification(?:\s+in)?|AWS\s+Certified|PMP|CPA|CISSP|CEH|CompTIA|Oracle|Microsoft|Google|Cisco)\b[^\n]{0,80}",
)
#: What any match of the certificate patterns contains.
CERTIFICATE_SIGNS = "certif|coursera|udemy|freecodecamp|edx|ibm|google|microsoft|cisco|oracle|comptia|aws|pmp|cpa|cissp|ceh|github|ui/ux|responsive|introduction|machine"
#: Contact details and scanning noise that no certificate contains.
NOT_IN_CERTIFICATES = r"\b(?:contact|http|www|linkedin|github|gralicon|gralcon|gmail|\.com|trees)\b"
CERTIFICATE_NOISE = frozenset((
    "nepal", "kathmandu", "maitidevi", "lalitpur", "bhaktapur", "contact", "phone", "email", "address", "mobile",
))
CERTIFICATE_ANCHORS = frozenset((
    "coursera", "udemy", "freecodecamp", "edx", "ibm", "google", "microsoft", "cisco", "oracle", "aws", "comptia", "certified", "certificate",
    "certification", "machine", "learning", "design", "python", "javascript", "responsive", "introduction", "fundamentals", "git", "github",
))

LANGUAGES = frozenset((
    "english", "hindi", "nepali", "nepal", "spanish", "french", "german", "chinese", "mandarin", "cantonese", "japanese", "korean", "arabic",
    "portuguese", "russian", "italian", "dutch", "turkish", "polish", "swedish", "danish", "norwegian", "finnish", "greek", "thai", "vietnamese",
    "indonesian", "malay", "tagalog", "bengali", "urdu", "tamil", "telugu", "marathi", "gujarati", "punjabi", "kannada", "malayalam", "sinhala",
    "burmese", "khmer", "lao", "tibetan", "sanskrit", "pali", "newari", "maithili", "bhojpuri", "awadhi", "swahili", "amharic", "yoruba", "igbo",
    "hausa", "zulu", "czech", "slovak", "hungarian", "romanian", "bulgarian", "serbian", "croatian", "bosnian", "albanian", "macedonian", "slovenian",
    "ukrainian", "belarusian", "georgian", "armenian", "azerbaijani", "persian", "farsi", "pashto", "dari", "kurdish", "hebrew", "afrikaans",
    "catalan", "basque", "galician", "welsh", "irish", "scottish", "gaelic", "latvian", "lithuanian", "estonian",
))
#: Signs before a language and levels after it.
LANGUAGE_TRIMS = (
    (r"^[+\-•*©°«\d\s()]+", ""),
    (r"(?i)[\-–—/~]+\s*(?:Native|Professional|Fluent|Proficiency|Intermediate|Basic|Conversational).*$", ""),
    (r"(?i)\s+(?:Native|Professional|Fluent|Intermediate|Basic|Conversational|Proficiency|Prfcercy|Professonal).*$", ""),
)
MISSPELT_LANGUAGES = {
    "exgith": "English", "engih": "English", "engish": "English", "englsh": "English", "engilsh": "English", "hind": "Hindi", "hinde": "Hindi", "hindl": "Hindi", "nepalr": "Nepali", "nepall": "Nepali", "nepa": "Nepali", "naive": "Native",
}
LANGUAGE_NOISE = frozenset(
    ("skills", "soft skills", "technical", "proficiency", "native", "professional", "vancuaces", "rececai", "naive", "communication", "creativity", "leadership", "teamwork", "problem solving", "fast learner", "time management", "adaptability", "collaboration", "presentation")
)
LANGUAGE_NOISE_STEMS = ("soft", "skill", "technic", "profic", "solving", "learner", "management", "adaptab", "collabor", "communicat", "creativ", "leadersh", "teamw")

#: Patterns of single fields.
EMAIL = r"[\w.+\-]+@[\w.\-]+\.[a-zA-Z]{2,6}"
EMAIL_GAPS = r"(\w+)\s*[@©®]\s*([\w\-]+(?:\s*\.\s*[a-zA-Z]{2,6})+)"
MISREAD_HOST = "@g(?:mai1|mall|maii|natcon|ralicaon|malicon|ralcon)"
NOISY_EMAIL = r"(?i)([a-zA-Z0-9_\.\+\-]{3,35})\s*[@©®S\d\s]{1,5}\s*([a-zA-Z0-9_\.\-]{0,25}(?:gralicon|gralcon|gnaticom|gmalicon|gmail|yahoo|hotmail|outlook|com)(?:\.[a-zA-Z]{2,6})?)"
#: What any match of the noisy pattern contains.
NOISY_HOSTS = "gralicon|gralcon|gnaticom|gmalicon|gmail|yahoo|hotmail|outlook|com"
KNOWN_HOSTS = "gmail|yahoo|hotmail|outlook|gralicon|gralcon|gmalicon|gnatcon|gnaticom"
NATIONAL_PHONE = r"(?:\+?977[\s\-]?)?(?:98\d{8}|97\d{8}|01\d{7})\b"
ANY_PHONE = r"(?:\+?\d{1,3}[\s\-\(\)]?)?\(?\d{2,4}\)?[\s\-\.]?\d{2,4}[\s\-\.]?\d{2,6}(?:\s?(?:#|x\.?|ext\.?|extension)\s?\d{1,5})?"
LINK = r"https?://[^\s,)>\"']+|www\.[^\s,)>\"']+"
LINKEDIN = r"(?i)linkedin\.com/in/[\w\-]+"
GITHUB = r"(?i)github\.com/[\w\-]+"
LOCATION_LABEL = r"(?i)(?:Address|Location|City|Residence|Based\s+in)\s*[:\-]\s*([^\n]{4,60})"
CITY_LINE = rf"(?i)\b(?:([A-Z][a-zA-Z]{{2,25}}(?:[\s\-][A-Z][a-zA-Z]{{2,25}})?\s*,\s*)?(?:{CITIES})(?:,\s*[A-Z][a-zA-Z]+)?)\b"
LOCATION_SPELLINGS = (
    (r"(?i)\b(?:Katenandta|Karthrrendu|Kathrresdu|Katesandu)\b", "Kathmandu"),
    (r"(?i)\b(?:Marites|Maries|Martidevi)\b", "Maitidevi"),
)
