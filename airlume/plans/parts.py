"""SQL of the intermediate results that oracles share."""

from __future__ import annotations

from airlume.plans.registry import PARTS


def loss(eta: int, pt: str = "pt_dbm", f: str = "freq_mhz", d: str = "distance_m") -> str:
    return (
        f"(10e0 * log10(power(10e0, 0.1e0 * {pt}) * power(3e8 / ({f} * 1e6), 2)"
        f" / (power(4e0 * pi(), 2) * power({d}, {eta}))))"
    )


MODELS = [f"model_{i}" for i in range(5)]
_LIST = ", ".join(MODELS)
_MEAN = f"(({' + '.join(MODELS)}) / 5e0)"


def spread(ddof: int) -> str:
    squares = " + ".join(f"power({m} - {_MEAN}, 2)" for m in MODELS)
    return f"sqrt(({squares}) / {5 - ddof}e0)"


MEDIAN = f"list_sort([{_LIST}])[3]"

PARTS["housed"] = """
    select m.sample_id, arg_min(b.measured_height, b.poly_id) h
    from {measurements} m join {buildings} b on b.site_id = m.site_id
     and m.longitude > b.xmin and m.longitude < b.xmin + b.w
     and m.latitude > b.ymin and m.latitude < b.ymin + b.h
    group by m.sample_id"""
PARTS["terrain"] = """
    select m.*, case when c.value in (-9999, -32767, -32768) then null else c.value end alt, c.value raw
    from {measurements} m join {raster_meta} g on g.site_id = m.site_id
    left join {raster_cells} c on c.site_id = m.site_id
     and c.r = cast(floor((g.y0 - m.latitude) / g.dy) as int)
     and c.c = cast(floor((m.longitude - g.x0) / g.dx) as int)"""
PARTS["receivers"] = """
    select t.sample_id, t.site_id, t.longitude, t.latitude, t.rssi,
           coalesce(t.alt, avg(t.alt) over (partition by t.site_id), 0e0) + coalesce(h.h, 0e0) dn,
           s.tx_lon, s.tx_lat, s.tx_alt, s.tx_ant_h, s.rx_ant_h, s.freq_mhz, s.pt_dbm
    from {terrain} t join {tx_sites} s on s.site_id = t.site_id left join {housed} h on h.sample_id = t.sample_id"""
PARTS["metres"] = """
    select *, 6371000e0 * (radians(longitude) - radians(tx_lon)) * cos(radians(tx_lat)) x_m,
           6371000e0 * (radians(latitude) - radians(tx_lat)) y_m,
           (dn + rx_ant_h) - (tx_alt + tx_ant_h) rise_m
    from {receivers}"""
PARTS["links"] = """
    select *, sqrt(x_m * x_m + y_m * y_m) r1, sqrt(x_m * x_m + y_m * y_m + rise_m * rise_m) distance_m,
           0.5e0 * sqrt(x_m * x_m + y_m * y_m + rise_m * rise_m) * tan(radians(30e0)) fresnel_h,
           0.5e0 * sqrt(x_m * x_m + y_m * y_m + rise_m * rise_m) * tan(radians(15e0)) fresnel_v,
           x_m / sqrt(x_m * x_m + y_m * y_m) cos_theta, y_m / sqrt(x_m * x_m + y_m * y_m) sin_theta,
           sqrt(x_m * x_m + y_m * y_m) / sqrt(x_m * x_m + y_m * y_m + rise_m * rise_m) cos_phi,
           rise_m / sqrt(x_m * x_m + y_m * y_m + rise_m * rise_m) sin_phi
    from {metres}"""
# The grid written in its three separate parts: before the transmitter, between, behind the receiver.
PARTS["grid"] = """
    select l.*, cast(i * 36 + j as int) cell_idx, cast(i as int) gi, cast(j as int) gj,
           case when j < 3 then (1e0 / 60e0 - (4 - j) / 30e0) * distance_m
                when j < 33 then (2 * (j - 3) - 1) / 60e0 * distance_m
                else (1e0 - 1e0 / 60e0 + (j - 33) / 30e0) * distance_m end px,
           (1e0 + 1e0 / 31e0 - 2e0 * i / 31e0) * fresnel_h py
    from {links} l, range(0, 31) a(i), range(0, 36) b(j)"""
PARTS["cells"] = """
    select *, degrees(radians(tx_lon) + (cos_phi * cos_theta * px - sin_theta * py)
                      / (6371000e0 * cos(radians(tx_lat)))) cell_lon,
           degrees(radians(tx_lat) + (cos_phi * sin_theta * px + cos_theta * py) / 6371000e0) cell_lat
    from {grid}"""
PARTS["mercator"] = """
    select *, 6378137e0 * radians(cell_lon) mx, 6378137e0 * ln(tan(pi() / 4 + radians(cell_lat) / 2)) my,
           distance_m / 29e0 len, distance_m / 29e0 * tan(radians(30e0)) wid
    from {cells}"""
PARTS["boxes"] = """
    select *, degrees((mx - len / 2) / 6378137e0) rx1, degrees((mx + len / 2) / 6378137e0) rx2,
           degrees(2 * atan(exp((my - wid / 2) / 6378137e0)) - pi() / 2) ry1,
           degrees(2 * atan(exp((my + wid / 2) / 6378137e0)) - pi() / 2) ry2
    from {mercator}"""
# Both sides cut into squares of 0.002 degrees, so that the join has keys.
PARTS["box_heights"] = """
    select c.sample_id, c.cell_idx, max(b.measured_height) bh
    from (select c.*, u.k kx, v.k ky from {boxes} c,
               lateral (select unnest(range(cast(floor(rx1 * 500) as bigint), cast(floor(rx2 * 500) as bigint) + 1)) k) u,
               lateral (select unnest(range(cast(floor(ry1 * 500) as bigint), cast(floor(ry2 * 500) as bigint) + 1)) k) v) c
    join (select b.*, u.k kx, v.k ky from {buildings} b,
               lateral (select unnest(range(cast(floor(xmin * 500) as bigint), cast(floor((xmin + w) * 500) as bigint) + 1)) k) u,
               lateral (select unnest(range(cast(floor(ymin * 500) as bigint), cast(floor((ymin + h) * 500) as bigint) + 1)) k) v) b
      on b.site_id = c.site_id and b.kx = c.kx and b.ky = c.ky
     and c.rx1 <= b.xmin + b.w and c.rx2 >= b.xmin and c.ry1 <= b.ymin + b.h and c.ry2 >= b.ymin
    group by 1, 2"""
PARTS["dem_windows"] = """
    select c.sample_id, c.cell_idx, c.site_id,
           greatest(least(cast(floor((g.y0 - ry2) / g.dy) as int), 60), 0) rs,
           greatest(least(cast(ceil((g.y0 - ry1) / g.dy + 1) as int), 60), 0) re,
           greatest(least(cast(floor((rx1 - g.x0) / g.dx) as int), 60), 0) cs,
           greatest(least(cast(ceil((rx2 - g.x0) / g.dx + 1) as int), 60), 0) ce
    from {boxes} c join {raster_meta} g on g.site_id = c.site_id"""
PARTS["dem_max"] = """
    select w.sample_id, w.cell_idx, max(p.value) alt
    from {dem_windows} w left join {raster_cells} p on p.site_id = w.site_id and p.r >= w.rs and p.r < w.re
     and p.c >= w.cs and p.c < w.ce and p.value <> -9999
    group by 1, 2"""
PARTS["lu_grid"] = """
    select site_id, x0, y0, nrows, ncols, (x_end - x0) / ncols dx, (y0 - y_end) / nrows dy
    from (select site_id, min(xmin) x0, max(xmin + w) x_end, max(ymin + h) y0, min(ymin) y_end,
                 cast(trunc((max(xmin + w) - min(xmin)) / 0.0001e0) as int) + 1 ncols,
                 cast(trunc((max(ymin + h) - min(ymin)) / 0.0001e0) as int) + 1 nrows
          from {landuse} group by site_id) b"""
# Candidate pixels one wider than the rectangle, then the exact centre test
# (a centre on the outline counts for the left and upper sides only).
PARTS["burned"] = """
    select site_id, r, c, arg_max(type, poly_id) type
    from (select p.site_id, p.poly_id, p.type, cast(a.r as int) r, cast(b.c as int) c,
                 g.x0, g.y0, g.dx, g.dy, p.xmin, p.ymin, p.w, p.h
          from {landuse} p join {lu_grid} g on g.site_id = p.site_id,
               lateral (select unnest(range(greatest(cast(floor((g.y0 - p.ymin - p.h) / g.dy) as bigint) - 1, 0),
                                            least(cast(floor((g.y0 - p.ymin) / g.dy) as bigint) + 2, g.nrows))) r) a,
               lateral (select unnest(range(greatest(cast(floor((p.xmin - g.x0) / g.dx) as bigint) - 1, 0),
                                            least(cast(floor((p.xmin + p.w - g.x0) / g.dx) as bigint) + 2, g.ncols))) c) b
         ) q
    where c + 0.5e0 + 1e-6 >= (xmin - x0) / dx and c + 0.5e0 + 1e-6 < (xmin + w - x0) / dx
      and r + 0.5e0 + 1e-6 >= (y0 - ymin - h) / dy and r + 0.5e0 + 1e-6 < (y0 - ymin) / dy
    group by 1, 2, 3"""
PARTS["lu_windows"] = """
    select c.sample_id, c.cell_idx, c.site_id,
           greatest(least(cast(floor((g.y0 - ry2) / g.dy) as int), g.nrows), 0) rs,
           greatest(least(cast(ceil((g.y0 - ry1) / g.dy + 1) as int), g.nrows), 0) re,
           greatest(least(cast(floor((rx1 - g.x0) / g.dx) as int), g.ncols), 0) cs,
           greatest(least(cast(ceil((rx2 - g.x0) / g.dx + 1) as int), g.ncols), 0) ce
    from {boxes} c join {lu_grid} g on g.site_id = c.site_id"""
PARTS["lu_pixels"] = """
    select w.sample_id, w.cell_idx, coalesce(p.type, 20) type
    from (select w.*, a.r, b.c from {lu_windows} w,
               lateral (select unnest(range(w.rs, w.re)) r) a, lateral (select unnest(range(w.cs, w.ce)) c) b) w
    left join {burned} p on p.site_id = w.site_id and p.r = w.r and p.c = w.c"""
PARTS["lu_mode"] = """
    select sample_id, cell_idx, type
    from (select sample_id, cell_idx, type,
                 row_number() over (partition by sample_id, cell_idx order by count(*) desc, type) k
          from {lu_pixels} group by sample_id, cell_idx, type) t
    where k = 1"""
PARTS["cell_values"] = """
    select c.*, coalesce(d.alt, avg(d.alt) over (partition by c.site_id), 0e0) + coalesce(b.bh, 0e0) dn_cell,
           coalesce(u.type, 20) type
    from {cells} c left join {dem_max} d on d.sample_id = c.sample_id and d.cell_idx = c.cell_idx
    left join {box_heights} b on b.sample_id = c.sample_id and b.cell_idx = c.cell_idx
    left join {lu_mode} u on u.sample_id = c.sample_id and u.cell_idx = c.cell_idx"""
_HEIGHT = """
    select *, -sin_phi * cos_theta * (6371000e0 * (radians(cell_lon) - radians(tx_lon)) * cos(radians(tx_lat)))
              - sin_phi * sin_theta * (6371000e0 * (radians(cell_lat) - radians(tx_lat)))
              + cos_phi * (dn_cell - (tx_alt + tx_ant_h)) height
    from {%s}"""
PARTS["cell_heights"] = _HEIGHT % "cell_values"
# The same without the map samples: a smooth surface over the cells, for the operators on heights.
PARTS["surface"] = """
    select *, 50e0 + (sample_id * 13 + cell_idx * 29) % 170 dn_cell,
           cast((sample_id * 7 + cell_idx * 5) % 27 as int) type from {cells}"""
PARTS["surface_heights"] = _HEIGHT % "surface"
_SLOPE = """
    select *, atan((coalesce(lead(height) over w, height) - coalesce(lag(height) over w, height))
                   / (case when gj in (0, 35) then 1e0 else 2e0 end * (distance_m / 29e0))) / (pi() / 2) slope
    from {%s} window w as (partition by sample_id, gi order by gj)"""
PARTS["feature_cells"] = _SLOPE % "cell_heights"
PARTS["surface_cells"] = _SLOPE % "surface_heights"

PARTS["stats"] = f"""
    select *, {MEDIAN} predicted_value, round({spread(0)}, 6) uncertainty, abs({MEDIAN} - rssi) abs_error
    from {{predictions}}"""
PARTS["expert_errors"] = """
    select sample_id, expert_id, err from (
        select sample_id, unnest([0, 1, 2, 3, 4]) expert_id,
               unnest([abs(model_0 - rssi), abs(model_1 - rssi), abs(model_2 - rssi), abs(model_3 - rssi),
                       abs(model_4 - rssi)]) err from {predictions}) e"""
PARTS["winners"] = """
    select p.*, w.best_model_idx, w.best_model_error
    from {predictions} p join (
        select sample_id, expert_id best_model_idx, err best_model_error
        from (select *, row_number() over (partition by sample_id order by err, expert_id) k from {expert_errors}) q
        where k = 1) w on w.sample_id = p.sample_id"""
