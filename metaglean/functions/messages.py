"""Short interface texts by locale, as a small table; English stands in for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = {
    "en": {"done": "Done: {count} files", "failed": "Failed: {count} files", "clean": "No metadata found", "removed": "Removed: {names}", "size": "Size: {size}"},
    "de": {"done": "Fertig: {count} Dateien", "failed": "Fehlgeschlagen: {count} Dateien", "clean": "Keine Metadaten gefunden", "removed": "Entfernt: {names}"},
    "fr": {"done": "Terminé : {count} fichiers", "failed": "Échec : {count} fichiers", "clean": "Aucune métadonnée trouvée"},
    "es": {"done": "Listo: {count} archivos", "failed": "Fallaron: {count} archivos", "clean": "Sin metadatos"},
}


def locales() -> list[str]:
    return sorted(MESSAGES)


def message(key: str, locale: str = "en", **values) -> str:
    text = MESSAGES.get(locale, {}).get(key) or MESSAGES["en"].get(key) or key
    for k, v in values.items():
        text = text.replace("{" + k + "}", str(v))
    return text


def translated(df: DataFrame, key: str, locale: str, into: str = "text") -> DataFrame:
    """``df`` with the text of each (locale, key)."""
    spark: SparkSession = df.sparkSession
    rows = [(lo, k, message(k, lo)) for lo in locales() for k in MESSAGES["en"]]
    t = spark.createDataFrame(rows, f"__locale string, __key string, {into} string")
    return df.join(F.broadcast(t), (F.col(locale) == t["__locale"]) & (F.col(key) == t["__key"]), "left").drop("__locale", "__key")
