"""STEP files: semicolons in texts, unlisted classes, property sets and quantities."""

import pytest

from spandrel.sources import step

TEXT = """ISO-10303-21;
DATA;
#1=IFCWALL('0000000000000000000001',#9,'Wall; the ''first''',$,$,#8,#7,'t1',$);
#2=IFCSOLARDEVICE('0000000000000000000002',#9,'Panel',$,
 $,#8,#7,'t2',$);
#3=IFCDOOR('0000000000000000000003',#9,'Door',$,$,#8,#7,$,$,$); #4=IFCDOOR('0000000000000000000004',#9,'Other',$,$,#8,#7,$,$,$);
#5=IFCPROPERTYSET('0000000000000000000005',#9,'Pset_WallCommon',$,(#10,#11,#12));
#6=IFCRELDEFINESBYPROPERTIES('0000000000000000000006',#9,$,$,(#1,#3),#5);
#10=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('EI 60'),$);
#11=IFCPROPERTYSINGLEVALUE('ThermalTransmittance',$,IFCREAL(0.5),$);
#12=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);
#13=IFCELEMENTQUANTITY('0000000000000000000013',#9,'Qto_Wall',$,$,(#14));
#14=IFCQUANTITYVOLUME('NetVolume',$,$,12.,$);
#15=IFCRELDEFINESBYPROPERTIES('0000000000000000000015',#9,$,$,(#1),#13);
#1=IFCWALL('0000000000000000000001',#9,'Later',$,$,#8,#7,'t1',$);
ENDSEC;
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_elements_and_their_attributes(spark, tmp_path, end):
    path = tmp_path / "m.ifc"
    path.write_bytes(TEXT.replace("\n", end).encode())
    got = step.instances(spark, str(path)).cache()
    elements = {r.express_id: (r.ifc_class, r.name) for r in step.elements(got).collect()}
    assert elements == {1: ("IfcWall", "Wall; the 'first'"), 2: ("IfcSolarDevice", "Panel"), 3: ("IfcDoor", "Door"), 4: ("IfcDoor", "Other")}
    properties = {(r.element_id, r.property_name): r.value for r in step.properties(got).collect()}
    assert properties[1, "FireRating"] == 'json:"EI 60"' and properties[3, "IsExternal"] == "json:true" and float(properties[1, "ThermalTransmittance"][5:]) == 0.5
    assert [tuple(r) for r in step.quantities(got).collect()] == [(1, "Qto_Wall", "NetVolume", 12.0, 1)]
