"""The registry of form fields as dimension tables. Its size is fixed, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, label, section, kind, pattern a value prefers, aliases; in the order of the form.
DATE = r"^(0[1-9]|[12][0-9]|3[01])[/.-](0[1-9]|1[012])[/.-](?:19|20)[0-9]{2}$"
DURATION = r"(?i)^[0-9]{1,2}\s*(h(\.)?\s*[0-9]{0,2}|heures?)?$"
REGISTRY = [
    ("nom_concours", "Nom du concours", "concours", "text", None, ["nom du concours", "nom concours"]),
    ("session", "Session", "concours", "text", None, ["session"]),
    ("concours", "Concours", "concours", "text", None, ["concours", "type de concours"]),
    ("epreuve", "Épreuve de", "concours", "text", None, ["epreuve de", "epreuve"]),
    ("date_concours", "Date", "concours", "date", DATE, ["date", "date du concours", "date de l epreuve"]),
    ("duree", "Durée", "concours", "duree", DURATION, ["duree", "duree de l epreuve"]),
    ("nom", "Nom", "candidat", "text", None, ["nom", "nom complet", "nom de famille", "nom et prenom"]),
    ("prenom", "Prénom", "candidat", "text", None, ["prenom", "prenom et nom"]),
    ("date_naissance", "Date & lieu de naissance", "candidat", "date", DATE, ["date et lieu de naissance", "date de naissance", "date et lieu", "date nee"]),
    ("etablissement", "Établissement d'origine", "candidat", "etablissement", None, ["etablissement", "etablissement d origine", "etablissement scolaire", "institut", "lycee"]),
    ("cin", "N° C.I.N ou N° du passeport pour les étrangers", "candidat", "cin", r"^[0-9]{8}$", [
        "numero cin", "n cin", "cin", "cin ou passeport", "n cin ou n du passeport", "numero du passeport", "numero passeport", "n passeport",
        "cin ou passeport pour les etrangers", "n cin ou n du passeport pour les etrangers", "n du passeport pour les etrangers",
    ]),
    ("serie", "Série", "codification", "serie", r"^[0-9]{3,4}$", ["serie", "serie du sujet", "n serie"]),
    ("identifiant", "Identifiant", "codification", "identifiant", None, ["identifiant", "identifiant d inscription", "numero identifiant"]),
    ("nombre_cahiers", "Nombre de cahiers remis", "codification", "count", r"^[1-5]$", ["nombre de cahiers", "nombre de cahiers remis", "nb de cahiers", "n cahiers"]),
    ("zone_signature", "Zone de signature des enseignants", "codification", "text", None, ["zone de signature des enseignants", "zone de signature", "signatures des enseignants"]),
    ("anonyme", "Bloc code-barres / Identifiant d'anonymat", "codification", "anonyme", None, [
        "bloc code barres identifiant d anonymat", "bloc code barres identifiant", "bloc code barres", "identifiant d anonymat", "identifiant anonymat",
        "code barres", "anonymat",
    ]),
]
#: The fields that every form shows, read or not.
TEMPLATE = ["concours", "epreuve", "date_concours", "duree", "nom", "prenom", "date_naissance", "etablissement", "cin", "serie", "identifiant"]
SECTIONS = ["concours", "candidat", "codification"]
#: Official short names of schools.
SCHOOLS = (
    "IPEIT", "IPEIN", "IPEIM", "IPEIS", "IPEIB", "IPEIK", "IPEIG", "IPEIEM", "FST", "FSB", "FSM", "FSS", "FSG", "FSGF", "INSAT", "ISSATSO", "ISSATK",
    "ISSATG", "ISSATM", "ISSATMH", "ISSATGF", "ESSTHS", "ESSTT", "ISI", "ISIMA", "ISIMS", "ISITCOM", "ISAMM", "ISIK", "ISIMGB", "ENIT", "ENSI", "EPT",
    "SUPCOM", "ENICAR", "ENISO", "ENIM", "ENIS", "ENIB", "ENIG", "INAT", "ESIAT", "ESTI", "ISETR", "ISETN", "ISETSO", "ISETS", "ISETB", "ISETK", "ISETG",
    "ISETGF", "ISETKR", "ISETMH", "ISETCOM", "ISETAR", "ISETKF", "ISETJ", "ISETSL", "ISETTZ", "ISETTT", "ISETMD", "ISETZ", "ISETSB", "AUTRE",
)
SCHOOL_RATIO = 0.72

ORDER = {r[0]: k for k, r in enumerate(REGISTRY)}
KIND = {r[0]: r[3] for r in REGISTRY}
PATTERN = {r[0]: r[4] for r in REGISTRY}
LABEL = {r[0]: r[1] for r in REGISTRY}
SECTION = {r[0]: r[2] for r in REGISTRY}
ALIASES = [(alias, r[0]) for r in REGISTRY for alias in r[5]]


def dim_field(spark: SparkSession) -> DataFrame:
    rows = [(k, r[0], r[1], r[2], r[3], r[4], r[0] in TEMPLATE) for k, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "ord int, key string, label string, section string, kind string, pattern string, in_template boolean")


def dim_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, key, k) for k, (a, key) in enumerate(ALIASES)], "alias string, key string, alias_ord int")


#: By alias: its place in the registry's order; the prefixes of a text are looked up among those of four letters or more.
EXACT = {a: k for k, (a, _) in reversed(list(enumerate(ALIASES)))}
LONG = {a: k for a, k in EXACT.items() if len(a) >= 4}
MOST_WORDS = max(len(a.split(" ")) for a in LONG)
FIRST_WORDS = sorted({a.split(" ")[0] for a in LONG})


def label_key(norm):
    """JN1 as an expression over the fixed registry: exact alias, else the first alias of four letters or more that begins the text
    as a whole word. No join: the registry is part of the plan, and a text is looked up by its first one, two, ... words, if any alias begins with its first."""
    place = lambda table, n: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), n)
    keys = F.array(*[F.lit(key) for _, key in ALIASES])

    def of(n):  # bound by transform(), so that the text is normalised once
        words = F.split(n, " ")
        begins = F.transform(F.sequence(F.lit(1), F.least(F.size(words) - 1, F.lit(MOST_WORDS))), lambda k: place(LONG, F.array_join(F.slice(words, F.lit(1), k), " ")))
        exact = F.when(n.isin(*EXACT), place(EXACT, n))
        return F.try_element_at(keys, F.coalesce(exact, F.when(F.substring_index(n, " ", 1).isin(*FIRST_WORDS) & F.contains(n, F.lit(" ")), F.array_min(begins))) + 1)

    return F.get(F.transform(F.array(norm), of), F.lit(0))


def longest_label(df: DataFrame, norm: str, out: str = "key") -> DataFrame:
    """JN2: the key of the longest alias that the text contains; ties go to the registry's order. One CASE, which stops at the first that is found; the
    text is bound by transform(), for a filter on the key would else put its expression in place of each mention."""

    def first(n):
        key = F.when(F.lit(False), "")
        for alias, name in sorted(ALIASES, key=lambda x: -len(x[0])):
            key = key.when(F.contains(n, F.lit(alias)), name)
        return key

    return df.withColumn(out, F.get(F.transform(F.array(F.col(norm)), first), F.lit(0)))


def kind_of(key):
    return F.try_element_at(F.create_map(*[F.lit(x) for p in KIND.items() for x in p]), key)


def order_of(key):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ORDER.items() for x in p]), key), F.lit(999))


def section_of(key):
    return F.try_element_at(F.create_map(*[F.lit(x) for p in SECTION.items() for x in p]), key)
