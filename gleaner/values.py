"""Word lists, tables, thresholds and patterns that results depend on."""

# Legal forms and fillers in company names.
LEGAL = (
    "gmbh mbh ag se kg kgaa ug ohg gbr ev e v co inc incorporated ltd limited llc llp plc sl slu sa sas sarl srl spa "
    "bv nv oy oyj ab as asa aps corp corporation company holding holdings group gruppe the and und"
).split()
# Words after a company's name that don't make it another company.
CORP_EXTRA = (
    "agency software technologies technology tech labs lab digital consulting solutions systems services studio "
    "studios international global europe deutschland germany spain españa iberia uk usa io app hq"
).split()
# Title words that say only how, how much or in which time zone.
TITLE_NOISE = (
    "remote remoto hybrid onsite on site vor ort homeoffice home office fully full part time vollzeit teilzeit "
    "anywhere worldwide global europe european emea eu eea dach apac latam mena amer americas timezones timezone "
    "time zones zone cet cest utc gmt deutschlandweit bundesweit wide nationwide ortsunabhängig and und or oder "
    "with mit percent m w d f x h"
).split()
# Words that don't count when titles and roles are compared; levels are optional in titles; generic words show no topic.
STOP = "and or of the for in a an to with m w d f x h remote de y".split()
MODIFIERS = "senior sr junior jr principal staff associate assistant".split()
GENERIC = (
    "remote hybrid onsite europe emea eu international global worldwide hiring team teams leadership management "
    "growth technology flexible startup start-up"
).split()
# Frequent short words of each language, in the order in which ties are resolved.
LANGUAGE_WORDS = {
    "german": (
        "und der die das nicht mit für wir sie ist auf bei eine einen dich du dein deine ihre ihr "
        "sowie oder auch zu von im den dem ein unser unsere werden wirst bist"
    ).split(),
    "english": "the and of to in for with you we our is are be will on as an or your this that".split(),
    "spanish": "el la los las de y en con para que un una por del nuestro nuestra tu es se al".split(),
    "french": "le la les des et en pour avec un une vous nous du est au votre notre sur dans".split(),
    "portuguese": "o os as em com para que um uma não você nós seu sua do da dos das na no ao".split(),
}
# Euro for one unit of a currency.
FX = {"EUR": 1.0, "USD": 0.86, "GBP": 1.16, "CHF": 1.06, "PLN": 0.23, "SEK": 0.088, "DKK": 0.134, "NOK": 0.085, "CAD": 0.62}
SOURCE_NAMES = {"remotive": "Remotive", "remoteok": "Remote OK", "arbeitnow": "Arbeitnow", "himalayas": "Himalayas", "jobicy": "Jobicy"}
COUNTRIES = {
    "AT": "Austria", "BE": "Belgium", "CH": "Switzerland", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark", "ES": "Spain", "FI": "Finland",
    "FR": "France", "GB": "United Kingdom", "GR": "Greece", "IE": "Ireland", "IT": "Italy", "NL": "Netherlands", "NO": "Norway", "PL": "Poland",
    "PT": "Portugal", "RO": "Romania", "SE": "Sweden", "US": "United States", "CA": "Canada",
}
DEAD_PAGE = (
    "job is no longer available",
    "this job has expired",
    "position has been filled",
    "no longer accepting applications",
    "job not found",
    "this position is closed",
)

# Patterns, to be matched without regard to case.
GENDER_TAG = (
    r"\(\s*(?:[mwfdxhi]|div|all genders?|alle geschlechter|gn\*?)(?:\s*[/|,]\s*(?:[mwfdxhi]|div|divers))*\s*\)"
    r"|\b[mwfhd]\s*/\s*[mwfhd]\s*(?:/\s*[dmwfx])?\b"
)
GENDER_ENDING = r"(?<=\w)(?:[:*_]|/-?)in(?:nen)?\b|\(in\)"
GENDER_TAG_VERDICT = r"\(\s*(?:[mwfdxh]\s*[/|,]\s*){1,3}[mwfdxh]\s*\)|\b(?:[mwfdxh]/){1,3}[mwfdxh]\b|\((?:all genders?|gn\*?|w\*m\*d)\)"
GENDER_TAG_KEY = r"\s*\((m|f|w|d|x|h)(/(m|f|w|d|x|h))+\)"
TIME_ZONES = r"\btime ?zones?\b|\bzeitzonen?\b"
REMOTE = r"\b(remote|remoto|anywhere|distributed|home ?office|home[- ]based|work from home|fully remote)\b"
CONTRACT = r"\b(interim|fractional|freelance|freelancer|contractor|contract role|b2b contract|temporary|consulting mandate|freiberuflich|projektbasis)\b"
JUNIOR = r"\b(intern|internship|trainee|werkstudent|working student|junior|graduate|apprentice|praktik)"
SENIOR_TITLE = r"\b(director|head|vp|vice president|chief|cto|cio|ceo|cfo|cmo)\b"
LOWER_LEVEL = r"\b(junior|jr|associate|assistant|coordinator|entry|trainee|intern)\b"
HIGHER_LEVEL = r"\b(director|head|vp|vice president|chief|principal|executive)\b"
NOT_A_JOB = (
    r"\b(talent pool|talent community|future opportunit|open application|spontaneous application|initiativbewerbung"
    r"|general application|expression of interest)"
)
US_ONLY = r"\b(us|u\.s\.|united states)[- ]only\b"

# Thresholds.
SIGNATURE_WORDS, SIGNATURE_SIZE, SIGNATURE_MIN_CHARS = 800, 64, 300
TITLE_JACCARD, TEXT_SAME, TEXT_WEAK, CUT_TITLE = 0.6, 0.9, 0.6, 70
ROLE_MIN, FULL_TEXT = 0.75, 600
LANGUAGE_MIN_HITS, LANGUAGE_MIN_SHARE, LANGUAGE_WORDS_READ = 12, 0.08, 600
MAX_AGE_DAYS, ALIAS_DAYS, REPEAT_DAYS = 45, 90, 30
DIGEST_MIN_SCORE, DIGEST_PER_COMPANY, DIGEST_DAILY, DIGEST_WEEKLY = 70, 2, 3, 7
PAGE_PER_COMPANY, PAGE_LIMIT = 3, 25
