"""Column expressions for link budgets and land-use codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Free-space loss at 1 m (dB) and minimum antenna height (m) per band (MHz).
FSPL_AT_1M = {220: 19.3, 429: 25.1, 920: 31.7}
MIN_ANTENNA_HEIGHT = {220: 2.5, 429: 1.8, 920: 1.5}

# Land-use class names; a class has the code of its place in the list, from 1.
LANDUSE_CLASSES = [
    "田（水田）",
    "畑（畑、樹園地、採草地、養鶏（牛・豚）場）",
    "山林（樹林地）",
    "水面（河川水面、湖沼、ため池、用水路、濠、運河水面）",
    "その他自然地（原野・牧野、荒れ地（耕作放棄地等自然的状況のもの）、低湿地、河川敷・河原、海浜、湖岸）",
    "住宅用地（住宅、共同住宅、店舗等併用住宅、店舗等併用共同住宅、作業所併用住宅）",
    "商業用地（業務施設、商業施設、宿泊施設、商業系複合施設）",
    "工業用地（工場）",
    "農林漁業施設用地（農林漁業用施設）",
    "公益施設用地（官公庁施設、文教厚生施設、供給処理施設）",
    "道路用地（道路、駅前広場、私有地内に存在する沿道用途の「私道」または、私有地の一部分であるものの公共の通行に供されている土地の部分）",
    "交通施設用地（運輸倉庫施設）",
    "公共空地（公園・緑地、広場、運動場、墓園）",
    "その他公的施設用地（防衛施設用地）",
    "その他①（ゴルフ場）",
    "その他②（太陽光発電のシステムを直接整備している土地）",
    "その他③（平⾯駐車場）",
    "その他④（その他①～③以外の用途に供されている都市的土地利用（建物跡地、資材置場、改変工事中の土地）、法⾯（道路、造成地等の主利用に含まれない法⾯））",
    "低未利用土地（用途に供されていない空地、空家・空き店舗・空施設の存する土地等）",
    "不明",
    "可住地",
    "非可住地",
    "農地（田、畑の区分がない）",
    "宅地（住宅用地、商業用地等の区分が無い）",
    "道路・鉄軌道敷（道路と交通施設用地が混在）",
    "空地（その他①～④の区分が無い）",
]
UNKNOWN_LANDUSE = 20
NO_READING_RSSI = -999


def path_loss(pt_dbm: Column, freq_mhz: Column, distance: Column, eta: float) -> Column:
    """Received power (dBm) over ``distance`` with decay exponent ``eta``; NULL at distance 0."""
    apart = F.when(distance > 0, distance)
    wavelength = 3e8 / (freq_mhz * 1e6)
    power = F.pow(F.lit(10.0), 0.1 * pt_dbm)
    return 10 * F.log10(
        power * F.pow(wavelength, 2) / (F.lit((4 * math.pi) ** 2) * F.pow(apart, F.lit(float(eta))))
    )


def target_value(rssi: Column, pt_dbm: Column, freq_mhz: Column, distance: Column) -> Column:
    """What a model learns: the reading minus free-space power, in dB."""
    return rssi - path_loss(pt_dbm, freq_mhz, distance, 2)


def restore_rssi(target: Column, pt_dbm: Column, freq_mhz: Column, distance: Column) -> Column:
    """Inverse of ``target_value``."""
    return path_loss(pt_dbm, freq_mhz, distance, 2) + target


def _by_band(freq_mhz: Column, values: dict[int, float]) -> Column:
    picked = F.lit(None).cast("double")
    for band, value in values.items():
        picked = F.when(freq_mhz == band, F.lit(value)).otherwise(picked)
    return picked


def fspl(freq_mhz: Column, distance: Column) -> Column:
    """Free-space loss of the three calibrated bands, NULL for others."""
    return _by_band(freq_mhz, FSPL_AT_1M) + 20 * F.log10(distance)


def attenuator_setting(
    freq_mhz: Column, distance: Column, gain_tx: Column, gain_rx: Column, cable_loss: Column
) -> Column:
    """Attenuation that makes a wired bench equal the wireless link."""
    return fspl(freq_mhz, distance) - (gain_tx + gain_rx) - cable_loss


def min_antenna_height(freq_mhz: Column) -> Column:
    return _by_band(freq_mhz, MIN_ANTENNA_HEIGHT)


def calibration_status(
    wired: Column, wireless: Column, distance: Column, height: Column, freq_mhz: Column,
    tolerance_db: float,
) -> Column:
    """Why a bench comparison is rejected, or whether it agrees."""
    return (
        F.when(distance < 1, "near_field")
        .when(height <= min_antenna_height(freq_mhz), "antenna_too_low")
        .when(F.abs(wired - wireless) <= tolerance_db, "calibrated")
        .otherwise("deviates")
    )


def landuse_code(class_name: Column) -> Column:
    """1..26 by class name, 0 for anything else (also for NULL)."""
    place = F.array_position(F.array(*[F.lit(c) for c in LANDUSE_CLASSES]), class_name)
    return F.coalesce(place, F.lit(0)).cast("int")
