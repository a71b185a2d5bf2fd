import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tendergrid import session  # noqa: E402

TABLES = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    made = session.local_session(cores="4", partitions=4, memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


# Invented contracts: a nested link, a padded name, missing keys, an amount with a currency sign.
PAGE_1 = [
    {
        "id_contrato": "PX-17/A",
        "nombre_entidad": "Museo del Puerto",
        "nit_entidad": "71",
        "fecha_de_firma": "2021-09-30T00:00:00.000",
        "fecha_de_inicio_del_contrato": "2021-10-11T00:00:00.000",
        "valor_del_contrato": "4310.25",
        "valor_facturado": "910.00",
        "valor_pagado": "260.75",
        "proveedor_adjudicado": "Taller Brisa",
        "documento_proveedor": "tb-9",
        "modalidad_de_contratacion": "Concurso",
        "urlproceso": {"url": "https://example.org/px17"},
        "ultima_actualizacion": "2022-01-10T00:00:00.000",
    },
    {
        "id_contrato": "PX-18",
        "nombre_entidad": " \tArchivo Ñuble  ",
        "nit_entidad": "72",
        "fecha_de_firma": "2022-11-04T00:00:00.000",
        "valor_del_contrato": "77.5",
        "valor_pagado": "0",
        "proveedor_adjudicado": "Taller Brisa",
        "documento_proveedor": "tb-9",
        "modalidad_de_contratacion": "Concurso",
        "ultima_actualizacion": "2023-01-20T00:00:00.000",
    },
]
PAGE_2 = [
    {
        "id_contrato": "QZ-3",
        "nombre_entidad": "Jardín Sur",
        "nit_entidad": "8",
        "fecha_de_firma": "2022-02-17T00:00:00.000",
        "valor_del_contrato": "€ 12,000.50",
        "proveedor_adjudicado": "Viveros Lima",
        "documento_proveedor": "vl-2",
        "modalidad_de_contratacion": "Subasta",
        "ultima_actualizacion": "2023-03-08T00:00:00.000",
    },
]


def write_page(folder, number, rows):
    name = f"socrata_page_{number:06d}_offset_{(number - 1) * 50000:010d}.json"
    path = folder / name
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return path


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write_page(folder, 1, PAGE_1)
    write_page(folder, 2, PAGE_2)
    return folder
