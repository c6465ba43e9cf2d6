"""Products, themes, legends and resolutions. Everything here is a fixed value that data and users count on."""

from __future__ import annotations

from typing import NamedTuple

# theme: (title, products in order)
THEMES = {
    "biomass-carbon": ("Biomass & Carbon", ["CCI_BIOMASS", "SAATCHI_BIOMASS", "LIU_BIOMASS", "ROBINSON_CR"]),
    "disturbance-change": ("Disturbance & Change", ["EFDA", "JRC_TMF", "HANSEN_GFC", "JRC_GFC2020", "RADD_EUROPE"]),
    "structure-demography": ("Structure & Demography", ["GAMI", "GAMI_AGECLASS", "POTAPOV_HEIGHT", "FORESTPATHS_GENUS", "WANG_FORESTAGE"]),
    "als-lidar": ("ALS / ULS / LiDAR", ["ALS_PRODUCTS", "ULS_PRODUCTS"]),
    "land-use-land-cover": ("Land Use & Land Cover", ["RESTOR_LANDUSE"]),
}

VERSIONS = {
    "CCI_BIOMASS": ["6.0", "7.0"],
    "SAATCHI_BIOMASS": ["2.0"],
    "LIU_BIOMASS": ["0.1"],
    "ROBINSON_CR": ["1.0"],
    "EFDA": ["2.1.1"],
    "JRC_TMF": ["2024"],
    "HANSEN_GFC": ["1.12"],
    "JRC_GFC2020": ["3.0"],
    "RADD_EUROPE": ["1.0"],
    "GAMI": ["2.0", "2.1", "3.0", "3.1"],
    "GAMI_AGECLASS": ["2.1", "3.0", "3.1"],
    "POTAPOV_HEIGHT": ["1.0"],
    "FORESTPATHS_GENUS": ["0.0.1"],
    "WANG_FORESTAGE": ["2.0"],
    "ALS_PRODUCTS": ["1.0"],
    "ULS_PRODUCTS": ["1.0"],
    "RESTOR_LANDUSE": ["2.0"],
}

AMAZON_ALBERS = "+proj=aea +lat_0=-12 +lon_0=-54 +lat_1=-2 +lat_2=-22 +x_0=5000000 +y_0=10000000 +ellps=GRS80 +units=m +no_defs"

ALS_SURFACES = ["chm", "dtm", "dsm"]
ALS_STRUCTURE = [
    "gap", "lai", "biomass", "h50", "h75", "h95", "hmax", "hmean", "cc", "density", "fhd", "vci", "crr",
    "pv_0_2", "pv_2_5", "pv_5_10", "pv_10_20", "pv_20_40", "pv_above40",
]
ULS_BANDS = [
    "n_segments", "n_valid_dbh", "dbh_m_mean", "dbh_median", "dbh_m_min", "dbh_m_max", "h_m_mean", "h_m_median", "h_m_min", "h_m_max",
    "crown_radius_m_mean", "crown_radius_m_median", "crown_radius_m_min", "crown_radius_m_max", "volume_m3_sum", "volume_m3_ha",
    "basal_area_m2_sum", "basal_area_m2_ha", "dbh_sd", "height_sd", "dbh_rmse", "dbh_rrmse", "dbh_perc_rrmse", "dbh_bias",
    "ba_rmse", "ba_rrmse", "ba_perc_rrmse", "ba_bias",
]

#: Resolutions of products that have several: resolution to variables (None: all).
RESOLUTIONS = {
    "GAMI_AGECLASS": {"1deg": None, "0.5deg": None, "0.25deg": None, "0.1deg": None, "0.0833deg": None},
    "ALS_PRODUCTS": {"1m": ALS_SURFACES, "10m": ALS_STRUCTURE, "100m": ALS_STRUCTURE},
    "ULS_PRODUCTS": {"10m": None, "20m": None, "100m": None},
}


class Region(NamedTuple):
    """A place of a collection: what its items' ids begin with, its extent, CRS and period."""

    name: str
    stem: str
    bbox: tuple[float, float, float, float]
    epsg: int
    first: str
    last: str


REGIONS = {
    "ALS_PRODUCTS": [
        Region("spain_pnoa", "ALS_SPAIN_PNOA", (-9.5, 35.9, 4.4, 43.8), 25830, "2015-01-01", "2023-12-31"),
        Region("brazil_eba", "ALS_BRAZIL_EBA", (-73.0, -15.0, -44.0, 5.0), 31983, "2016-01-01", "2018-12-31"),
    ],
    "ULS_PRODUCTS": [
        Region("hainich", "ULS_HAINICH", (10.408, 51.034, 10.498, 51.124), 32632, "2022-01-01", "2022-12-31"),
        Region("test_region", "ULS_TEST_REGION", (10.408, 51.034, 10.498, 51.124), 32632, "2022-01-01", "2022-12-31"),
    ],
}

LEGENDS = {
    "agent": {0: "no_disturbance", 1: "wind_bark_beetle", 2: "fire", 3: "harvest"},
    "genus": {0: "larix", 1: "picea", 2: "pinus", 3: "fagus", 4: "quercus", 5: "other_needleleaf", 6: "other_broadleaf", 7: "no_trees"},
    "land_use": {
        1: "Annual agriculture", 2: "Semi-perennial agriculture", 3: "Water", 4: "Forest", 5: "Silviculture", 6: "Secondary vegetation", 7: "Mining",
        8: "Urbanized area", 9: "Non-forest natural vegetation", 10: "Pasture", 11: "Seasonally flooded", 12: "Deforestation of the year",
        13: "Perennial agriculture", 14: "Not observed",
    },
    "moist_forest": {
        10: "Undisturbed Tropical Moist Forest", 20: "Degraded TMF", 30: "TMF regrowth", 41: "Deforested → plantation", 42: "Deforested → water",
        43: "Deforested → other land cover", 50: "Ongoing deforestation or degradation (2022–2024)", 60: "Permanent or seasonal water",
        70: "Other land cover (including afforestation)",
    },
    "moist_forest_subtypes": {
        10: "Undisturbed TMF", 11: "Bamboo-dominated forest", 12: "Undisturbed mangroves", 21: "Degraded forest (<2015)", 22: "Degraded forest (2015–2023)",
        23: "Long degradation (<2015)", 24: "Long degradation (2015–2023)", 31: "Old forest regrowth", 32: "Young forest regrowth", 33: "Very young forest regrowth",
        41: "Deforestation (<2014)", 42: "Deforestation (2014–2021)", 51: "Deforestation (2022)", 52: "Deforestation (2023)", 53: "Deforestation (2024)",
    },
    "moist_forest_annual": {
        1: "Undisturbed Tropical Moist Forest", 2: "Degraded TMF", 3: "Deforested land", 4: "Forest regrowth", 5: "Permanent or seasonal water", 6: "Other land cover",
    },
    "age_class": {
        0: "0-20", 1: "20-40", 2: "40-60", 3: "60-80", 4: "80-100", 5: "100-120", 6: "120-140", 7: "140-160", 8: "160-180", 9: "180-200", 10: "200-299", 11: ">299",
    },
}
