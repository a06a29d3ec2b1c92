"""Phones and e-mail addresses as native column expressions.

Phones follow RU/KZ and CIS rules; other international numbers are accepted with 8 to 15 digits, as no
phone metadata library is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country codes written without a plus, and the shapes of phones and addresses.
CIS_CODES = ("375", "380", "998", "996", "994", "995", "992", "993", "374", "373")
PHONE = (
    r"\+\d{1,3}(?:[ \-.]?\(?\d{2,7}\)?){2,5}(?!\d)"
    r"|(?<![\d\p{L}_])(?:" + "|".join(CIS_CODES) + r")[ \-.]?\(?\d{2,3}\)?[ \-.]?\d{3}[ \-.]?\d{2}[ \-.]?\d{2}(?!\d)"
    r"|(?<![\d\p{L}_])(?:8|7)?[\s\-(.]*\d{3}[\s\-).]*\d{3}[\s\-.]*\d{2}[\s\-.]*\d{2}(?!\d)"
)
EMAIL = r"(?iu)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[a-zа-я]{2,}"


def normalize_phone(value: Column) -> Column:
    """E.164, or null for short, toll-free and impossible numbers."""
    text = F.regexp_replace(F.trim(value), r"\.0$", "")
    digits = F.regexp_replace(text, r"\D", "")
    n, plus = F.length(digits), text.startswith("+")
    number = (
        F.when(plus, digits)
        .when((n == 12) & digits.rlike("^(?:" + "|".join(CIS_CODES) + ")"), digits)
        .when((n == 11) & digits.rlike("^[78]"), F.concat(F.lit("7"), F.substring(digits, 2, 10)))
        .when(n == 10, F.concat(F.lit("7"), digits))
    )
    russian = number.startswith("7")
    good = F.when(russian, number.rlike(r"^7[34789]\d{9}$") & ~number.startswith("7800")).otherwise(number.rlike(r"^\d{8,15}$"))
    return F.when(good, F.concat(F.lit("+"), number))


def extract_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), normalize_phone)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def extract_emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))


def normalize_email(text: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, EMAIL, 0), F.lit("")))


def email_key(email: Column) -> Column:
    """The address as a key: one mailbox of gmail has many spellings."""
    name, domain = F.split_part(email, F.lit("@"), F.lit(1)), F.split_part(email, F.lit("@"), F.lit(2))
    gmail = F.concat(F.regexp_replace(F.regexp_replace(name, r"\+.*$", ""), r"\.", ""), F.lit("@gmail.com"))
    return F.when(domain.isin("gmail.com", "googlemail.com"), gmail).otherwise(email)


def contact_keys(text: Column) -> Column:
    """Distinct keys of a text's phones, then of its addresses."""
    return F.array_distinct(F.concat(extract_phones(text), F.transform(extract_emails(text), email_key)))
