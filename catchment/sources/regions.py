"""Regions of the world and names of countries, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of each region (ISO 3166 alpha-2), in the order of the source's lists.
AFRICA = "DZ AO BJ BW BF BI CM CV CF TD KM CG CD CI DJ EG ER SZ ET GA GM GH GN GW KE LS LR LY MG MW ML MR MU MA MZ NA NE NG RW RE ST SN SL SO ZA SS SD TZ TG TN UG ZM ZW"
EUROPE = "AL AD AT BY BE BA BG HR CY CZ DK EE FI FR DE GR HU IS IE IT LV LI LT LU MT MD MC ME NL MK NO PL PT RO RU SM RS SK SI ES SE CH UA GB VA"
NORTHERN_AMERICA = "CA PR US"
SOUTH_AMERICA = "AR BO BR CL CO EC GY PY PE SR UY VE"
CENTRAL_AMERICA = "BZ CR SV GT HN MX NI PA"
CARIBBEAN = "AG AW BM BS BB CU CW DM DO GD GP HT JM KN LC MQ VC TT TC VG"
EAST_ASIA = "CN HK JP KP KR MN MO TW"
SOUTH_CENTRAL_ASIA = "AF BD BT IN IR KZ KG MV NP PK LK TJ TM UZ"
SOUTHEAST_ASIA = "BN KH TL ID LA MY MM PH SG TH VN"
WEST_ASIA = "AM AZ BH GE IQ IL JO KW LB OM PS QA SA SY TR AE YE"
OCEANIA = "AU FJ KI MH FM NR NZ PW PG WS SB TO TV VU"
#: Name, code, name in the incidence source, members, of the regions below the world.
PARTS = [
    ("Africa", "AFR", "Africa", AFRICA),
    ("Europe", "EUR", "Europe", EUROPE),
    ("Northern America", "NAM", "Northern America", NORTHERN_AMERICA),
    ("South America", "SAM", "South America", SOUTH_AMERICA),
    ("Central America", "CAM", "Central America", CENTRAL_AMERICA),
    ("Caribbean", "CAR", "Caribbean", CARIBBEAN),
    ("East Asia", "EAS", "Eastern Asia", EAST_ASIA),
    ("South & Central Asia", "SCA", "South Central Asia", SOUTH_CENTRAL_ASIA),
    ("Southeast Asia", "SEA", "South Eastern Asia", SOUTHEAST_ASIA),
    ("West Asia", "WAS", "Western Asia", WEST_ASIA),
    ("Oceania", "OCE", "Oceania", OCEANIA),
]
#: Fixed value: the finest resolution that a region's cells are kept at.
REGION_RES = 3
#: Names of countries in the standard, and in the facility source where they differ.
ALIASES = {
    "United States": "USA",
    "United States of America": "USA",
    "Russian Federation": "Russia",
    "Korea, Republic of": "South Korea",
    "Korea, Democratic People's Republic of": "North Korea",
    "Iran, Islamic Republic of": "Iran",
    "Syrian Arab Republic": "Syria",
    "Viet Nam": "Vietnam",
    "Bolivia, Plurinational State of": "Bolivia",
    "Venezuela, Bolivarian Republic of": "Venezuela",
    "Moldova, Republic of": "Moldova",
    "Tanzania, United Republic of": "Tanzania",
    "Taiwan, Province of China": "Taiwan",
    "North Macedonia": "Macedonia",
    "Ireland": "Republic of Ireland",
    "Réunion": "Reunion",
    "Türkiye": "Turkey",
    "Côte d'Ivoire": "Cote D’Ivoire",
    "Congo, The Democratic Republic of the": "Democratic Republic of Congo",
    "Lao People's Democratic Republic": "Laos",
    "Czechia": "Czech Republic",
    "Cabo Verde": "Cape Verde",
    "Timor-Leste": "East Timor",
    "Gambia": "The Gambia",
    "Bosnia and Herzegovina": "Bosnia - Herzegovina",
    "Bahrain": "Kingdom of Bahrain",
    "Brunei Darussalam": "Brunei",
    "Curaçao": "Curacao",
}


def regions(spark: SparkSession) -> DataFrame:
    """name, code, csv_name, members array, max_res. World has each member of the others once."""
    parts = spark.createDataFrame([(*r[:3], r[3].split(), REGION_RES) for r in PARTS], "name string, code string, csv_name string, members array<string>, max_res int")
    world = parts.select(F.explode("members").alias("m")).agg(F.sort_array(F.collect_set("m")).alias("members"))  # a few hundred countries
    return parts.unionByName(world.select(F.lit("World").alias("name"), F.lit("WLD").alias("code"), F.lit("World").alias("csv_name"), "members", F.lit(REGION_RES).alias("max_res")))


def members(spark: SparkSession) -> DataFrame:
    """region (code), alpha2: a row for each country of each region."""
    return regions(spark).select(F.col("code").alias("region"), F.explode("members").alias("alpha2"))


def aliases(spark: SparkSession) -> DataFrame:
    """name, source_name: how the facility source calls a country."""
    return spark.createDataFrame(list(ALIASES.items()), "name string, source_name string")
