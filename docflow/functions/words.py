"""Word lists and patterns of the text heuristics."""

# fixed values: common English words, for the likelihood that a sentence is English
COMMON_ENGLISH = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she
or an will my one all would there their what so up out if about who get which go me when make can like time no just
him know take people into year your good some could them see other than then now look only come its over think also
back after use two how our work first well way even new want because any these give day most us is was are been has
had were said did having may should could must
""".split()

# fixed values: openings that are typical of English, in lower-cased text, each before white space
ENGLISH_OPENINGS = [
    ("the|a|an", True),
    ("is|are|was|were|am", False),
    ("have|has|had", False),
    ("will|would|could|should|might|may", False),
    ("you|he|she|it|we|they", False),
]

# fixed values: words that never enter a glossary
STOPWORDS = """
a an the
i you he she it we they me him her us them
my your his her its our their mine yours hers ours theirs
this that these those
in on at by with from to of for about after before behind beside between among through during above below under
over into onto upon across along around near against toward towards within without
and or but so yet for nor as if although though because since unless until while when where whether
am is are was were be been being have has had having do does did doing can could will would shall should may might must
all any some many much few little more most each every both either neither other another such
very too quite rather really just only also even still already yet again once twice always never often sometimes
usually here there now then soon later ago today tomorrow yesterday
come go get make take bring put give keep let seem become turn
well oh yes no okay ok anyway however therefore moreover furthermore meanwhile otherwise
who whom whose what which why how
ah oh uh um hmm huh hey wow
""".split()

# fixed values: titles that are no terms, and words that are no proper nouns
TITLES = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Sir", "Lady"]
NOT_NOUNS = ["the", "a", "an", "this", "that", "these", "those", "i"]

#: Every white-space character, as a character class that Java and RE2 read alike.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Letters, digits and the underscore of any script, inside brackets.
WORD = r"\p{L}\p{N}_"
SEPARATOR = "</>"
END_MARK = "[=[END]=]"
ERROR_MARK = "[ERREUR"
