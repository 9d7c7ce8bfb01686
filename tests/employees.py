"""A small employee file with NULLs, odd names, bad values and duplicates."""

HEADER = [
    "Badge",
    "Called",
    "Mail to",
    "Tax id",
    "Desk (ext). ",
    "Pay",
    "Years of age.",
    "Years here (full)",
    "Parking lot.",
    "First day",
    "First month",
    "First year",
]

ROWS = [
    ("1", "Ann", "ann@mail.org", "123-45-6789", "5550001", "120000.5", "30.5", "3", "60", "20010203", "2", "2001"),
    ("2", "Bo", "bo@mail.org", "001-01-0001", "5550002", "90000", "41", "10", "81.5", "3/4/2005", "3", "2005"),
    ("3", "Cy", "cy at mail", "000-12-3456", "212-376-9125", "150000", "52", "20", "70", "20110101", "1", "2011"),
    ("4", None, "di@mail.org", "666-12-3456", "5550004", "50000", "23", "1", "55", "20180909", "9", "2018"),
    ("4", "Ed", None, "900-12-3456", "5550005", "55000", "23", "1", "90", "20180909", "9", "2018"),
    ("6", "Flo", "flo@mail.org", None, None, "101000", "35", "5", "64", "20120505", "5", "2012"),
    (None, "Gus", "gus@mail.org", "123-00-6789", "5550007", None, "61", "33", "77", "19900606", "6", "1990"),
    ("8", "Hal", "hal@mail.org", "123-45-0000", "5550008", "200000", None, "7", None, "20100707", "7", "2010"),
    ("9", "Ida", "ida@mail.org", "555-44-3333", "5550009", "x", "44", None, "58", "20040808", "13", "2004"),
    ("10", "Jo", "jo@mail.org", "219-09-9999", "5550010", "99999.5", "29", "2", "66", None, None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name in HEADER))
