"""Word lists and constants that filters, weights and parsers share."""

from __future__ import annotations

import re

# Words and numbers that results depend on.
FEED_ROLE_WORDS = ("software", "developer", "engineer", "ai", "data", "machine learning", "backend", "frontend", "fullstack", "python", "java")
LOCKED_PLACES = ("shanghai", "beijing", "mumbai", "bangalore", "moscow", "tx", "ca", "ny", "california", "texas", "new york", "india", "china", "russia")
# "sr." is a pattern, not text: its dot stands for any character, so it also drops "sre"
SENIOR_WORDS = ("senior", "sr", "sr.", "lead", "principal", "manager", "director", "staff", "head", "vp", "president", "architect")
SENIOR_CODES = ("l[4-9]", "l1[0-2]", "ic[4-9]", "ic1[0-2]", "e[4-9]", "g[7-9]", "g1[0-2]", r"sde\s*[2-9]", "sde-?[2-9]", r"swe\s*[2-9]", "swe-?[2-9]")
# patterns without word boundaries: "rust" is in "trust" and "intern" in "internal"
ROLE_PATTERNS = (
    "software engineer", "software developer", "backend", "frontend", "fullstack", "full-stack", "full stack", "web developer", "web engineer", "programmer",
    "python", "java developer", "java engineer", "javascript", "typescript", r"c\+\+", "c#", "golang", "rust", "kotlin", "swift", "react", "node.js", "django", "fastapi", "flask",
    "ml engineer", "ai engineer", "machine learning", "deep learning", "data scientist", "data engineer", "data analyst", "artificial intelligence", "neural", "nlp", "natural language",
    "computer vision", "llm", "large language model", "generative ai", "research engineer", "research scientist",
    "devops", "site reliability", "sre", "platform engineer", "cloud engineer", "cloud developer", "infrastructure engineer", "systems engineer", "embedded",
    "member of technical staff", "intern",
)
INTERN_BLOCKERS = (
    "biology", "biomed", "biotech", "biochem", "pharma", "medical", "nursing", "business analyst", "business analytics", "social media", "communications intern", "pr intern", "public relations",
    "hr intern", "human resources", "recruiting intern", "accounting", "finance intern", "tax intern", "audit intern", "legal intern", "law intern", "marketing analyst intern", "brand intern",
)
NON_TECH_SIGNALS = ("sales ", "marketing ", " hr ", " hr-", "recruiter", "talent acquisition", "customer success", "account executive", "account manager", " operations ", "social media", "copywriter", "growth ", "business development")
SCAM_WORDS = ("scam", "fraud", "fake job", "fraudulent", "did not pay", "didn't pay", "ghost job", "ponzi", "pyramid scheme")
INDIA_SIGNALS = ("india", "pvt ltd", "pvt. ltd", "private limited", "(p) ltd", "pvt limited", "bangalore", "bengaluru", "hyderabad", "mumbai", "delhi", "noida", "gurgaon", "chennai", "pune", "kolkata", "ahmedabad")
GEO_PLACES = (
    "canada", "canadian", "australia", "australian", "australasia", "new zealand", "united kingdom", "uk", "britain", "british", "england", "scotland", "wales", "ireland",
    "germany", "german", "austria", "austrian", "switzerland", "swiss", "france", "french", "italy", "italian", "spain", "spanish", "portugal", "portuguese", "greece", "greek",
    "netherlands", "dutch", "belgium", "belgian", "sweden", "swedish", "norway", "norwegian", "denmark", "danish", "finland", "finnish", "poland", "polish",
    "romania", "romanian", "hungary", "hungarian", "bulgaria", "bulgarian", "ukraine", "ukrainian",
    "brazil", "brazilian", "argentina", "argentine", "mexico", "mexican", "chile", "chilean", "colombia", "colombian", "peru", "peruvian",
    "india", "indian", "china", "chinese", "japan", "japanese", "south korea", "korean", "singapore", "thailand", "thai", "vietnam", "vietnamese", "philippines", "filipino",
    "indonesia", "indonesian", "malaysia", "malaysian", "south africa", "south african", "nigeria", "nigerian", "kenya", "kenyan", "russia", "russian",
    "turkey", "türkiye", "turkish", "israel", "israeli", "saudi arabia", "uae", "united arab emirates", "qatar", "kuwait", "bahrain", "oman",
    "eu", "european union", "eea", "latam", "latin america", "apac", "asia pacific", "asia-pacific", "anz",
)
WEB_TRIGGERS = ("eligible countries", "selected countries", "certain countries", "must be based", "candidates based", "residents of", "remote in the", "must be located", "work authorization", "within the united states", "us only", "us-based", "uk only", "eu only")
WEB_GLOBAL = ("worldwide", "globally remote", "anywhere in the world", "no location restriction", "no geographic restriction", "open to all locations", "global candidates", "emea welcome", "middle east", "fully remote globally", "all countries", "global remote")
WEB_AMBIGUOUS = ("timezone", "country", "region", "office", "headquartered", "headquarters", "based ", "located in")
# names of regions; a space stands for any white space, other signs are regular expressions
REGION_NAMES = {
    "heavily_deweighted": ("russia", "moscow", r"st[.\s]+petersburg", "china", "beijing", "shanghai", "shenzhen", "north korea", "dprk", "belarus", "minsk", "iran", "tehran"),
    "highly_preferred": (
        "worldwide", "anywhere", "global(?:ly)?", "fully remote", "100% remote", r"remote[\s-]*first", "palestin(?:e|ian)", "west bank", "gaza", "ramallah", "nablus", "hebron", r"al[-\s]?khalil",
        "bethlehem", "jenin", "tulkar(?:e)?m", "qalqilya", "jericho", r"bir\s*zeit", "uae", r"u\.a\.e", "dubai", r"abu\s*dhabi", "jordan", "amman", "egypt", "cairo", "alexandria", "saudi arabia", "riyadh", "jeddah",
        "qatar", "doha", "bahrain", "kuwait", "oman", "muscat", "lebanon", "beirut", "turkey", "türkiye", "istanbul", "ankara", "south africa", "johannesburg", "cape town", "kenya", "nairobi", "nigeria", "lagos", "abuja",
        "ghana", "accra", "morocco", "casablanca", "rabat", "tunisia", "tunis",
    ),
    "preferred": (
        "germany", "berlin", "munich", "munchen", "hamburg", "france", "paris", "lyon", "netherlands", "amsterdam", "rotterdam", "utrecht", "ireland", "dublin", "spain", "madrid", "barcelona", "italy", "rome", "milan",
        "portugal", "lisbon", "porto", "poland", "warsaw", "krakow", "sweden", "stockholm", "denmark", "copenhagen", "finland", "helsinki", "norway", "oslo", "austria", "vienna", "belgium", "brussels", "switzerland", "zurich",
        "geneva", "united kingdom", "england", "scotland", "london", r"(?<!new\s)manchester", "edinburgh", "czech republic", "czechia", "prague", "romania", "bucharest", "hungary", "budapest", "greece", "athens", "bulgaria",
        "sofia", "croatia", "zagreb", "serbia", "belgrade", "estonia", "tallinn", "lithuania", "vilnius", "latvia", "riga", "georgia", "canada", "toronto", "vancouver", "montreal", "brazil", "brasil", "sao paulo", "são paulo",
        "rio de janeiro", "argentina", "buenos aires", "mexico", "méxico", "mexico city", "chile", "santiago", "colombia", "bogota", "bogotá", "medellin", "medellín", "peru", "lima", "uruguay", "montevideo", "costa rica",
        "latam", "latin america", "europe", "emea", r"eu[-\s]based", "sri lanka", "colombo", "bangladesh", "dhaka", "nepal", "kathmandu", "pakistan", "lahore", "islamabad",
    ),
    "deweighted": (
        "india", "indian", r"pvt\.?\s*ltd", r"pvt\.?\s*limited", "private limited", r"\(p\)\s*ltd", "bangalore", "bengaluru", "mumbai", "delhi", "new delhi", "noida", "gurgaon", "gurugram", "chennai", "pune", "kolkata",
        "hyderabad", "ahmedabad", "jaipur",
    ),
}
REGION_WEIGHTS = {"highly_preferred": 1.30, "preferred": 1.15, "neutral": 1.00, "deweighted": 0.70, "heavily_deweighted": 0.50}
TRUSTED_WEIGHT = 1.25
AI_ROLES = (
    "ai (?:engineer|developer|scientist|intern|researcher|architect|lead)", "artificial intelligence", "ml (?:engineer|ops|intern|developer|researcher|scientist)", "mlops", "machine learning", "deep learning",
    "neural network", "nlp", "natural language processing", "computer vision", "llm (?:engineer|intern|developer|researcher)", "large language model", "generative ai", r"gen\s*ai", "data scien(?:tist|ce)",
    "research (?:engineer|scientist)", "applied scientist", "rag (?:engineer|developer)", "ai/ml", "ml/ai",
)
SOFTWARE_ROLES = (
    "software (?:engineer|developer)", r"(?:backend|back[-\s]end) (?:engineer|developer)", r"(?:frontend|front[-\s]end) (?:engineer|developer)", r"full[-\s]?stack (?:engineer|developer)", "fullstack",
    "web (?:developer|engineer)", "mobile (?:developer|engineer)", "ios developer", "android developer", "java (?:developer|engineer)", "python developer", "javascript (?:developer|engineer)", "typescript developer",
    "react developer", r"node\.?js developer", "django developer", "member of technical staff", "systems? engineer", "embedded (?:developer|engineer)", "junior (?:developer|engineer)", r"entry[-\s]level (?:developer|engineer)",
)
ROLE_WEIGHTS = {"ai": 1.20, "swe": 1.10, "other": 1.00}
PATH_WEIGHT = 1.20
PATHS = {
    "backend": (r"back[\s-]?end", r"server[\s-]?side", "apis?", "microservices?", r"node(?:\.js)?", "django", "fastapi", "spring"),
    "frontend": (r"front[\s-]?end", "react", "vue", "angular", r"next\.?js", "ui (?:developer|engineer)", "web (?:developer|engineer)"),
    "fullstack": (r"full[\s-]?stack",),
    "mobile": ("mobile", "ios", "android", "flutter", "react native", "swift", "kotlin"),
    "ai_ml": AI_ROLES,
    "data_science": ("data scien(?:tist|ce)", "machine learning", "statistician"),
    "data_analysis": ("data analyst", "analytics", "business intelligence", "bi (?:analyst|developer)"),
    "data_engineering": ("data engineer", "etl", "data pipelines?", "(?:data )?warehouse", "spark"),
    "devops": ("devops", "sre", "site reliability", "platform engineer", "cloud engineer", "infrastructure engineer", "kubernetes"),
    "qa": ("qa", "quality assurance", "test (?:engineer|automation)", "sdet", "automation engineer"),
    "security": ("security (?:engineer|analyst)", "appsec", "infosec", "penetration tester", r"cyber\s*security"),
    "embedded": ("embedded", "firmware", "rtos", "hardware engineer"),
    "game": ("game (?:developer|engineer|programmer)", "unity", "unreal", "gameplay"),
}
PATH_LABELS = {
    "backend": "Backend", "frontend": "Frontend", "fullstack": "Full-Stack", "mobile": "Mobile", "ai_ml": "AI/ML", "data_science": "Data Science", "data_analysis": "Data Analysis", "data_engineering": "Data Engineering",
    "devops": "DevOps/SRE", "qa": "QA/Test", "security": "Security", "embedded": "Embedded", "game": "Game Dev",
}
RETRYABLE = (
    "500", "502", "503", "504", "UNAVAILABLE", "INTERNAL", "BAD_GATEWAY", "GATEWAY_TIMEOUT", "timeout", "Timeout", "TIMEOUT", "ConnectionError", "ConnectError", "connection error",
    "rate limit", "Rate limit", "rate_limit", "RATE_LIMIT", "429", "overloaded", "Overloaded", "OVERLOADED", "service unavailable", "Service Unavailable",
)
TOO_LARGE = ("413", "request too large", "tokens per minute", "reduce your message")
USEFUL_TEXT, RETRIEVAL_FROM, TOKEN_DAYS, CV_TEXTS = 500, 50, 30, 50
JOB_PATHS = ("jobs?", "career", "careers", "position", "positions", "vacanc[yi]e?s?", "apply", "openings?", "role", "roles", "job[-_]posting", "job[-_]post", "posting", "postings", "employment", "hire", "work-with-us", "join-us", "we[-_]are[-_]hiring")
OTHER_PATHS = (
    "blog", "blogs", "news", "press", "press-release", "press[-_]releases", "article", "articles", "posts?", "whitepapers?", "case-stud[yi]e?s?", "insight", "insights", "event", "events", "research", "about", "contact", "team",
    "leadership", "investor", "investors", "legal", "privacy", "terms", "podcast", "webinar", "webinars", "market[-_]update", "market[-_]updates", "customer[-_]stor[yi]e?s?", "help", "support", "faq", r"(?:19|20)\d{2}",
)
OTHER_STARTS = ("cookie", "login", "sign[-_]in", "sign[-_]up")
LANDING_PATHS = ("jobs?", "careers?", "positions?", "vacanc[yi]e?s?", "openings?", "roles?", "employment", "work-with-us", "join-us")
DEAD_URLS = ("not[-_]found", "no[-_]longer[-_]available", "position[-_]closed", "job[-_]closed", "listing[-_]closed", "expired", "removed", "page[-_]not[-_]found", "/404", "/410", "error")
DEAD_STATUS = (404, 410, 451)
SHORT, TERSE, MISSING = 150, 100, 20
CARD_LIMITS = {"flagged": 55, "scam": 30}
SIMILARITY_FLOOR, SAME_POSTING = 0.30, 0.97
TOP_N, WILDCARDS, LOWER_RANKED, LOWER_SHOWN, SHOWN_FLOOR = 55, 5, 25, 15, 55
LOOKBACK_DAYS = {"seen": 60, "history": 14, "text_cache": 14, "detection": 30, "stale_ats": 60, "seen_purge": 90, "embeddings_purge": 30, "results_purge": 90}
RUNS_PER_DAY = 2
BUDGET_ZONE = "Asia/Jerusalem"


def grouped(names) -> str:
    """One pattern for any of names, with what names begin with alike written once: a text is then held against few
    beginnings at each place in place of all names. Which texts match stays as it is; names are patterns, so only plain letters, digits
    and blanks at their beginning are shared."""
    plain = lambda n: len(n) > 1 and (n[0].isalnum() or n[0] == " ") and n[1] not in "?*+{"
    groups: dict[str, list[str]] = {}
    for n in dict.fromkeys(names):
        # what is an alternation itself, or has no letter to share, stays whole
        groups.setdefault(n[0] if plain(n) and not _open_alternation(n) else n, []).append(n)
    out = []
    for head, own in groups.items():
        if len(own) == 1:
            out.append(own[0])
            continue
        rest = [n[1:] for n in own]
        out.append(head + "(?:" + grouped(rest) + ")")
    return "|".join(out)


def _open_alternation(pattern: str) -> bool:
    """Whether a | of the pattern stands outside all groups."""
    depth = 0
    for i, c in enumerate(pattern):
        if i and pattern[i - 1] == "\\":
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            return True
    return False


def words(names, flags: str = "(?iU)") -> str:
    """One pattern for any of names as whole words; a space in a name is any white space."""
    return flags + r"\b(?:" + grouped(n.replace(" ", r"\s+") for n in names) + r")\b"


def anywhere(names, flags: str = "") -> str:
    return flags + "(?:" + "|".join(names) + ")"


def literal(names) -> str:
    return "|".join(map(re.escape, names))
