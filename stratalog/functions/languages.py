"""Programming languages by name and by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages in their order, their spellings, their file extensions (case-sensitive) and display names.
LANGUAGES = [
    "ASM",
    "ASP",
    "ActionScript",
    "C",
    "Cpp",
    "CSharp",
    "CoffeeScript",
    "Lisp",
    "Cobol",
    "CSS",
    "Clojure",
    "D",
    "Eiffel",
    "Elixir",
    "Elm",
    "Erlang",
    "FSharp",
    "Fortran",
    "Go",
    "Groovy",
    "HTML",
    "Haskell",
    "Java",
    "JavaScript",
    "Julia",
    "Kotlin",
    "Lua",
    "ObjectiveC",
    "OCaml",
    "PHP",
    "Pascal",
    "Python",
    "Perl",
    "R",
    "Racket",
    "Ruby",
    "Rust",
    "Scala",
    "SQL",
    "Scheme",
    "Swift",
    "TypeScript",
    "VisualBasic",
    "Other",
]
SPELLINGS = {
    "ASM": ["asm", "assembly"],
    "ASP": ["asp", "classic asp"],
    "Cpp": ["c++"],
    "CSharp": ["c#"],
    "Lisp": ["common lisp", "lisp"],
    "FSharp": ["f#"],
    "ObjectiveC": ["objective-c", "objective c", "objectivec"],
    "Perl": ["perl", "perl 6", "perl6"],
    "SQL": ["sql", "sqlpl"],
    "VisualBasic": ["visual basic", "visual basic .net"],
}
EXTENSIONS = {
    "C": ["c", "h"],
    "Cpp": ["C", "cc", "cpp", "cxx", "c++", "hpp"],
    "ObjectiveC": ["m", "mm", "M"],
    "Go": ["go"],
    "Java": ["java"],
    "CoffeeScript": ["coffee", "litcoffee"],
    "JavaScript": ["js", "mjs"],
    "TypeScript": ["ts", "tsx"],
    "Ruby": ["rb"],
    "Rust": ["rs"],
    "Python": ["py", "pyi", "pyc", "pyd", "pyo", "pyw", "pyz"],
    "Perl": ["plx", "pl", "pm", "xs", "t", "pod"],
    "Clojure": ["clj", "cljs", "cljc", "edn"],
    "Erlang": ["erl", "hrl"],
    "Haskell": ["hs", "lhs"],
    "Scala": ["scala", "sc"],
    "R": ["r", "rscript"],
    "PHP": ["php", "phtml", "php3", "php4", "php5", "php7", "phps", "php-s", "pht", "phar"],
    "VisualBasic": ["vb"],
    "Swift": ["swift"],
    "Scheme": ["scm", "ss", "sls", "sps", "sld"],
    "Racket": ["rkt"],
    "SQL": ["sql", "pls", "pks"],
    "Pascal": ["pp", "pas", "inc"],
    "OCaml": ["ml", "mli"],
    "Lua": ["lua"],
    "Kotlin": ["kt", "kts"],
    "Julia": ["jl"],
    "HTML": ["html", "htm"],
    "Groovy": ["groovy", "gvy", "gy", "gsh"],
    "Fortran": ["f90", "for", "f"],
    "FSharp": ["fs", "fsi"],
    "Elm": ["elm"],
    "Elixir": ["ex", "exs"],
    "Eiffel": ["e"],
    "D": ["d"],
    "CSS": ["css"],
    "Cobol": ["cbl", "cob", "cpy"],
    "Lisp": ["lisp", "lsp", "l", "cl", "fasl"],
    "CSharp": ["cs"],
    "ActionScript": ["as", "swf"],
    "ASP": ["asp"],
    "ASM": ["asm", "s"],
}
DISPLAY = {
    "Cpp": "C++",
    "CSharp": "C#",
    "ObjectiveC": "Objective-C",
    "ASM": "Assembly",
    "Lisp": "LISP",
    "FSharp": "F#",
    "VisualBasic": "Visual Basic",
}

_BY_NAME = {s: k for k in LANGUAGES if k != "Other" for s in SPELLINGS.get(k, [k.lower()])}
_BY_EXTENSION = {e: k for k, es in EXTENSIONS.items() for e in es}


def _map(entries: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def language_of_name(name: Column) -> Column:
    """By name in any case; null for an unknown one."""
    return F.try_element_at(_map(_BY_NAME), F.lower(name))


def language_of_path(path: Column) -> Column:
    """By extension; null without one (a name that only starts with a dot has none), Other for an unknown one."""
    extension = F.regexp_extract(path, r"(?:^|/)[^/]+[.]([^./]*)$", 1)
    return F.when(path.rlike(r"(^|/)[^/]+[.][^./]*$"), F.coalesce(F.try_element_at(_map(_BY_EXTENSION), extension), F.lit("Other")))


def ordinal(language: Column) -> Column:
    """The language's place in the fixed order, which breaks ties."""
    return F.try_element_at(_map({k: i for i, k in enumerate(LANGUAGES)}), language)


def display_name(language: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DISPLAY), language), language)
