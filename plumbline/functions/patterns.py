"""Regular expressions in the common subset of Java and RE2 syntax."""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# Area not 000, 666 or 9xx; group not 00; serial not 0000.
SOCIAL_SECURITY_NUMBER = (
    r"(^|[^0-9])"
    r"(00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])"
    r"-(0[1-9]|[1-9][0-9])"
    r"-(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"
    r"([^0-9]|$)"
)

# Whole texts, for which ``$`` would not do: in Java it also stands before a last line break.
INTEGRAL = r"\A[-+]?[0-9]+\z"
FRACTIONAL = r"\A[-+]?([0-9]+[.][0-9]*|[.][0-9]+)\z"
BOOLEANS = ("true", "false")
