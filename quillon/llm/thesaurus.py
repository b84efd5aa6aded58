"""Short forms of subject names in general use in libraries and shops, and what people say instead of the name: a
parameter of the mapping to canonical values. Names beyond these are learned from the data."""

CATEGORIES = {
    "Science Fiction": ["sf", "scifi", "sci-fi"],
    "Young Adult": ["ya"],
    "Literary Fiction": ["lit fic"],
    "Popular Science": ["pop sci"],
    "Mathematics": ["math", "maths"],
    "Psychology": ["psych"],
    "Economics": ["econ"],
    "Biography": ["biog"],
    "Philosophy": ["phil"],
    "Cooking": ["cookery", "cookbooks"],
    "Film Studies": ["cinema", "movies"],
    "Graphic Novels": ["comics"],
    "Poetry": ["poems", "verse"],
}
